"""How the sources of a language differ in their words.

Identical texts of a language are collapsed first: a text is named by its
SHA-256, its rows are counted per source, and only one copy is read for words.
Its counts, and the number of documents it stands for, are then added to each
of its sources as often as the source has it.

Each language keeps the terms that at least ``min_docs`` of its documents hold.
A term's share in a group (language and source) is
``p = 1 + floor(1e9 (count + 5) / (N + 5 V))``, N the group's kept occurrences
and V the language's kept terms; decimals keep it exact at any size.

Two sources are compared over all kept terms: the sum of ``|p - q|``.  A term
that neither has adds the same to every such pair, so only terms that one
has are looked at: kept entries are dealt into blocks of terms of one language,
each block holds a column of shares per source, and a block hands on one number
per pair of sources, not per pair and term.

Null text, lang and source count as ''.  A group without kept terms takes part;
a language without any has pairs of value 0.  Repeated rows count as often as
they occur.  An empty table gives an empty result.  The sources of one distinct
text, a name and a number each, travel in one row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostlens.llm.common import col, materialize, query, small_batches, table

MIN_DOCS, SCALE, SMOOTHING, TOP_TERMS = 30, 1_000_000_000, 5, 50
#: counts a worker gathers before it hands them on, and shares of a block
HELD, BLOCK_ENTRIES = 200_000, 10_000
#: everything that parts terms becomes a space, A-Z become a-z
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def collapsed(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, sources): each text of a language once, with how many rows of
    which source have it.

    Rows are counted by the digest of their text, so a text moves once per task that
    reads it, however many copies it has there.
    """
    own = [F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = docs.select(*own).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = (
        rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
        .groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    )
    once = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return once.join(copies, ["lang", "digest"]).select("lang", "text", "sources")


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of ``collapsed`` texts: occurrences, and
    documents that hold the term.  Workers add up what they read; all counts of a
    language's term then meet in one place, at most one per worker, source and
    ``HELD`` counts."""
    small_batches(texts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in counts.items():
                if not n:
                    continue
                words = pa.array(list(n), pa.binary()).cast(pa.string())
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32))) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays(
                    [*names, words, pa.array(list(n.values()), pa.int64()), pa.array([docs[w] for w in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            counts.clear()

        held = 0
        for batch in batches:
            for lang, text, sources in zip(*(c.to_pylist() for c in batch.columns)):
                words = terms(text)
                once = set(words)
                for x in sources:
                    n, docs = counts[lang, x["source"]]
                    before = len(n)
                    if x["n"] == 1:
                        n.update(words)
                        docs.update(once)
                    else:
                        for word, times in Counter(words).items():
                            n[word] += times * x["n"]
                            docs[word] += x["n"]
                    held += len(n) - before
                    if held >= HELD:
                        yield from handed_on()
                        held = 0
        yield from handed_on()

    found = texts.select("lang", "text", "sources").mapInArrow(walk, _COUNTS)
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """``1 + floor(SCALE (n + 5) / (total + 5 kept))``, exactly; null if nothing is kept."""
    whole = lambda x: f"CAST({x} AS DECIMAL(20,0))"
    below = f"{whole(total)} + {whole(SMOOTHING)} * {whole(kept)}"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + ({whole(SCALE)} * ({whole(n)} + {SMOOTHING})) div ({below}) END")


def kept_entries(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Entries of terms that enough documents of the language hold, with the term's
    occurrences in the language (lang_n).  Counts as ``term_counts`` leaves them are not
    moved again."""
    whole = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("lang_docs", F.sum("docs").over(whole)).withColumn("lang_n", F.sum("n").over(whole))
        .where(F.col("lang_docs") >= min_docs).drop("lang_docs", "docs")
    )


def groups(docs: DataFrame, entries: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, kept, entries, sources, lang_total, zero): a row per group.

    ``zero`` is the share of a term the group lacks; ``entries`` and ``sources`` count
    kept entries and groups of the language.
    """
    named = [F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    found = docs.select(*named).distinct()
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    held = entries.groupBy("lang").agg(F.count("*").alias("entries"))
    per_term = entries.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    totals = per_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    crowd = found.groupBy("lang").agg(F.count("*").alias("sources"))
    return (
        found.join(own, ["lang", "source"], "left").join(totals, "lang", "left").join(held, "lang", "left").join(crowd, "lang")
        .fillna(0, ["total", "kept", "entries", "lang_total"])
        .withColumn("zero", F.coalesce(share("0", "total", "kept"), F.lit(0)))
    )


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring edges."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[edges])


def compare(names: list[str], zeros: np.ndarray, source: np.ndarray, term: np.ndarray, shares: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source g: what the terms of a block add to its distance from the
    sources after it, beyond ``|zero - zero|`` for each term.

    Entries (source, term, share) are sorted by source.  Terms of the other source
    are compared one by one.  For terms of g alone, the distance of all its shares
    from any zero comes from prefix sums over its sorted shares; those that the
    other source has as well are taken off.
    """
    edges = np.searchsorted(source, np.arange(len(names) + 1))
    width = int(term.max()) + 1 if len(term) else 0
    own, has = np.empty(width, np.int64), np.zeros(width, bool)
    for g in range(len(names) - 1):
        mine = slice(edges[g], edges[g + 1])
        own[:], has[:] = zeros[g], False
        own[term[mine]], has[term[mine]] = shares[mine], True
        apart = np.abs(zeros[g] - zeros)
        rest = slice(edges[g + 1], None)
        other, at = source[rest], term[rest]
        theirs = np.abs(own[at] - shares[rest]) - apart[other]
        theirs -= np.where(has[at], np.abs(own[at] - zeros[other]) - apart[other], 0)
        ordered = np.sort(shares[mine])
        prefix = np.concatenate(([0], np.cumsum(ordered)))
        below = np.searchsorted(ordered, zeros)
        alone = zeros * (2 * below - len(ordered)) + prefix[-1] - 2 * prefix[below] - len(ordered) * apart
        yield g, _sums(theirs, edges[g + 1 :] - edges[g + 1]) + alone[g + 1 :]


def pair_values(entries: DataFrame, found: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources, ``source`` < ``item``."""
    # a block holds every source once besides its entries
    blocks = F.greatest(F.lit(1), F.ceil(F.col("entries") / F.greatest(F.lit(block_entries), 4 * F.col("sources")))).cast("int")
    dealt = found.withColumn("blocks", blocks)
    own = dealt.select("lang", "source", "total", "kept", "blocks")
    shares = entries.join(own, ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term",
        share("n", "total", "kept").alias("share"), F.lit(0).cast("long").alias("kept"),
    )
    zeros = dealt.select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
        F.lit(None).cast("string").alias("term"), F.col("zero").alias("share"), "kept",
    )
    kind = "lang string, source string, item string, value long"

    def walk(key: tuple, rows: pa.Table) -> pa.Table:
        blank = rows["term"].is_null()
        sources = rows.filter(blank).sort_by("source")
        names, zero = sources["source"].to_pylist(), sources["share"].to_numpy()
        here = rows.filter(rows["term"].is_valid())
        number = {s: i for i, s in enumerate(names)}
        source = np.array([number[s] for s in here["source"].to_pylist()], np.int64)
        order = np.argsort(source, kind="stable")
        term = here["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # what all kept terms would add if nobody had them goes with the first block
        kept = sources["kept"].to_numpy() if key[1].as_py() == 0 else np.zeros(len(names), np.int64)
        made: list[list] = [[], [], []]
        for g, sums in compare(names, zero, source[order], term[order], here["share"].to_numpy()[order]):
            made[0] += [names[g]] * len(sums)
            made[1] += names[g + 1 :]
            made[2].append(sums + kept[g] * np.abs(zero[g] - zero[g + 1 :]))
        values = np.concatenate(made[2]) if made[2] else np.zeros(0, np.int64)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(values), pa.string()), "source": pa.array(made[0], pa.string()),
            "item": pa.array(made[1], pa.string()), "value": pa.array(values),
        })

    parts = shares.unionByName(zeros).groupBy("lang", "block").applyInArrow(walk, kind)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(entries: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms whose share in the group is above the language's."""
    own = found.select("lang", "source", "total", "kept", "lang_total")
    p, q = share("n", "total", "kept"), share("lang_n", "lang_total", "kept")
    return (
        entries.join(own, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    )


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    counts = term_counts(collapsed(docs, text, lang, source))
    entries = materialize(kept_entries(counts, min_docs), "kept-terms")
    found = materialize(groups(docs, entries, lang, source), "audit-groups")
    one_way = materialize(pair_values(entries, found), "source-pairs")
    back = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    pairs = one_way.unionByName(back).withColumn("part", F.lit("pair")).select(*columns, rank)
    best = term_values(entries, found).withColumn("part", F.lit("term")).select(*columns, rank).where(F.col("rank") <= top_terms)
    return pairs.unionByName(best)


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
),
words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30
),
entries AS (
    SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
),
sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM entries GROUP BY ALL),
own AS (
    SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
    FROM own g JOIN kept k USING (lang) LEFT JOIN entries e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term
),
pairs AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
    FROM own g JOIN own h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (
        SELECT a.lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
    ) d ON d.lang = g.lang AND x = g.source AND y = h.source
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM (
        SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
    QUALIFY rank <= 50
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


@query("op13_source_audit", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
