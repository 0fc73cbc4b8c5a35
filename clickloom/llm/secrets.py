"""Secret scanning with a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, small_batches, written

BLOCK_ROWS = 20_000  # documents that one block of the index covers, about


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # syntax that Python and Java read alike
    any_case: bool = False
    group: int = 0  # what must have ``least`` characters
    least: int = 0
    base: bool = False


# The contract's base rules, in its order, then well-known public credential formats.
RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # the same matches as runs of which short ones are dropped
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
]

Query = list[frozenset[str]]  # alternatives, each a set of trigrams that must all occur; [] means no condition


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str, limit: int = 32) -> Query:
    """The Boolean trigram query of a regex: any text with a match satisfies it.

    The parse tree is walked left to right with the set of strings that the last part can
    have spelled.  Where that is no longer a small finite set, the trigrams of each of its
    strings become an alternative, and conditions of neighbouring parts are multiplied out.
    """
    done: list[Query] = []

    def flush(strings: set[str]) -> None:
        if all(len(s) >= 3 for s in strings):
            done.append([trigrams(s) for s in sorted(strings)])

    def exact(tree) -> set[str] | None:
        """All strings of a part, if they are few."""
        out = {""}
        for op, arg in tree:
            if op is sre.LITERAL:
                own = {chr(arg)}
            elif op is sre.IN and all(x is sre.LITERAL for x, _ in arg) and len(arg) <= 8:
                own = {chr(v) for _, v in arg}
            elif op is sre.SUBPATTERN:
                own = exact(arg[3])
            elif op is sre.BRANCH:
                parts = [exact(x) for x in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif op is sre.MAX_REPEAT and arg[1] <= 1:
                inner = exact(arg[2])
                own = None if inner is None else inner | {""} if arg[0] == 0 else inner
            else:
                own = None
            if own is None or len(out) * len(own) > limit:
                return None
            out = {a + b for a in out for b in own}
        return out

    def walk(tree, strings: set[str]) -> set[str]:
        for item in tree:
            own = exact([item])
            if own is not None and len(strings) * len(own) <= limit:
                strings = {a + b for a in strings for b in own}
                continue
            flush(strings)
            strings = {""} if own is None else own
            if own is None and item[0] is sre.SUBPATTERN:
                strings = walk(item[1][3], {""})
        return strings

    flush(walk(sre_parse.parse(pattern), {""}))
    alternatives = reduce(lambda a, b: [x | y for x in a for y in b], done) if done else []
    return [x for i, x in enumerate(alternatives) if not any(y < x or (y == x and j < i) for j, y in enumerate(alternatives))]


def rule_query(rule: Rule) -> Query:
    return trigram_query(rule.pattern.lower() if rule.any_case and "\\" not in rule.pattern.replace("\\x20", "") else rule.pattern)


def _terms() -> tuple[list[tuple[str, bool]], list[tuple[int, list[int]]]]:
    """Distinct terms (trigram, whether in lower-cased text) and alternatives (rule, its terms)."""
    terms: dict[tuple[str, bool], int] = {}
    alternatives = []
    for r, rule in enumerate(RULES):
        for alt in rule_query(rule):
            alternatives.append((r, [terms.setdefault((t, rule.any_case), len(terms)) for t in sorted(alt)]))
    return list(terms), alternatives


def candidates(docs: DataFrame, blocks: int) -> DataFrame:
    """_key, rules: documents that satisfy the trigram query of a rule, by a bitmap of rules.

    Only trigrams that some query names are indexed.  A posting list covers one block of
    documents (a hash range of keys), so its length is bounded; lists are intersected per block and
    alternative.
    """
    terms, alternatives = _terms()
    low = F.lower("text")
    hits = F.array_compact(F.array(*(F.when(F.contains(low if lower else F.col("text"), F.lit(t)), F.lit(i)) for i, (t, lower) in enumerate(terms))))
    postings = docs.select("_key", F.pmod(F.xxhash64("_key"), F.lit(blocks)).alias("block"), F.explode(hits).alias("term")).groupBy("block", "term").agg(F.collect_set("_key").alias("ids"))
    rows = ", ".join(f"({i}, {r}, {t}, {len(ts)})" for i, (r, ts) in enumerate(alternatives) for t in ts)
    uses = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(alt, rule, term, need)")  # its size is fixed by the rules
    met = (
        postings.join(F.broadcast(uses), "term")
        .groupBy("block", "alt", "rule", "need")
        .agg(F.sort_array(F.collect_list(F.struct(F.size("ids").alias("n"), F.col("ids").alias("ids")))).alias("lists"))
        .where(F.size("lists") == F.col("need"))
    )
    both = F.aggregate(F.slice("lists", 2, 1 << 20), F.col("lists")[0]["ids"], lambda acc, x: F.array_intersect(acc, x["ids"]))
    return met.select("rule", F.explode(both).alias("_key")).groupBy("_key").agg(F.expr("bit_or(shiftleft(1, rule))").alias("rules"))


def _spans(rule: Rule, index: int, text: Column) -> Column:
    """Matches of a rule in order, as (start, kind index, end), in code points.

    The text splits at the matches, so the lengths of matches and of what lies between them
    give all positions.
    """
    pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    pairs = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, 1, F.size(found)).alias("p"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,ok:boolean>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["p"])).alias("start"), F.lit(index).alias("kind"), (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), (F.length(x["v"]) >= rule.least).alias("ok")))).alias("out"),
    )
    return F.filter(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]), lambda x: x["ok"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Find secrets in every whole text: doc_id, spans (array of start, kind index, end, by start, then kind).

    Null text counts as empty.  Rows of equal id are scanned each for itself; a row with a
    null id is verified for every rule.  Spans of different kinds may overlap; those of one
    kind are leftmost and don't.  An empty table gives an empty result; other columns are not read.

    Rules with mandatory trigrams are verified on documents that the index names; rules
    without (``hex``) are run on every text.

    With ``whole``, the text (empty for null), whether it was null (no_text) and a struct ``row`` of the other columns come along.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = [F.col(text_col).isNull().alias("no_text"), row_of(docs, text_col).alias("row")] if whole else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    keyed = base.withColumn("_key", F.coalesce("doc_id", F.xxhash64("text")))
    named = written(candidates(keyed.where("doc_id is not null"), max(1, base.count() // BLOCK_ROWS)), "secret-candidates")
    joined = keyed.join(named.hint("shuffle_hash"), "_key", "left")
    mask = F.when(F.col("doc_id").isNull(), F.lit((1 << len(RULES)) - 1)).otherwise(F.coalesce("rules", F.lit(0)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,ok:boolean>>")
    parts = []
    for i, rule in enumerate(RULES):
        wanted = mask.bitwiseAND(F.lit(1 << i)) != 0 if rule_query(rule) else F.col("text").rlike("[0-9a-f]{24}" if rule.kind == "hex" else rule.pattern)
        parts.append(F.when(wanted, _spans(rule, i, F.col("text"))).otherwise(none))
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return joined.select("doc_id", spans.alias("spans"), *(["text", "no_text", "row"] if whole else []))


def masked(text: Column, spans: Column) -> Column:
    """The text with the characters of the spans (ordered by start) overwritten by asterisks; its parts are put together once."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["end"] <= acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.repeat(F.lit("*"), s["end"] - F.greatest(s["start"], acc["at"]))))
        ).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def named_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("spans", lambda x: x["kind"] < sum(r.base for r in RULES))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base),
        F.sha2(named_spans(base), 256).alias("base_sha256"),
        named_spans(F.col("spans")).alias("spans"),
    )


def reference_spans(text: str | None) -> list[tuple[int, str, int]]:
    """The same by plain matching of every rule, for tests."""
    out = []
    for i, rule in enumerate(RULES):
        for m in re.compile(rule.pattern, (re.I | re.A) if rule.any_case else re.A).finditer(text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), i, rule.kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def _sql() -> str:
    """The rows of ``scan_digests``, by running every rule on every text."""
    parts = []
    for i, r in enumerate(RULES):
        p = (("(?i)" if r.any_case else "") + r.pattern).replace("'", "''")
        parts.append(f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS v, string_split_regex(text, '{p}') AS p, {r.least} AS least FROM d WHERE regexp_matches(text, '{p}')")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, k, kind, least, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, k, kind, CAST(list_sum(list_transform(p[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda t: length(t))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM x WHERE length(v[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()
