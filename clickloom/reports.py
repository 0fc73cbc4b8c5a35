"""What a run leaves for readers: tables, curves, a report, a package to hand on."""

from __future__ import annotations

import csv
import shutil
from pathlib import Path

from pyspark.sql import DataFrame

#: A report is for reading; longer tables are for parquet, and are named in it with their first rows.
REPORT_ROWS = 200


def _cell(v) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")


def markdown(df: DataFrame, rows: int = REPORT_ROWS) -> str:
    """The first rows of a table; says so where there are more."""
    found = df.limit(rows + 1).collect()
    lines = [f"| {' | '.join(df.columns)} |", f"|{'-|' * len(df.columns)}", *(f"| {' | '.join(map(_cell, r))} |" for r in found[:rows])]
    if len(found) > rows:
        lines.append(f"\n(the first {rows} rows)")
    return "\n".join(lines)


def build_report(title: str, tables: dict[str, DataFrame], path: str, rows: int = REPORT_ROWS) -> str:
    """One markdown file with a section per table."""
    text = "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df, rows)}" for name, df in tables.items())]) + "\n"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return text


def save_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table whole, as parquet, and the list of them as text."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return output_manifest(sorted(tables), folder)


def output_manifest(names: list[str], folder: str) -> list[str]:
    """A text file that lists the outputs of a folder, one a line; remote folders get none, as the list is returned too."""
    if "://" not in folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / "outputs.txt").write_text("".join(f"{folder}/{n}\n" for n in names), encoding="utf-8")
    return names


def save_curve(df: DataFrame, path: str) -> int:
    """A curve of few points (bins, epochs, ranks) as one csv file, streamed row by row."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for n, r in enumerate(df.toLocalIterator(), 1):
            out.writerow(r)
    return n


def export_run(root: str, run_id: str, output: str) -> str:
    """A run's folder as one zip file; its path."""
    if not (Path(root) / run_id).is_dir():
        raise FileNotFoundError(f"no run {run_id!r} in {root}")
    return shutil.make_archive(str(Path(output).with_suffix("")), "zip", root, run_id)
