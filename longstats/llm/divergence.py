"""Source divergence audit: how the word use of a language's sources differs.

Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII; a
language keeps the terms that enough of its documents hold.  Every (language,
source) group and every language gives each kept term a smoothed share ``p`` in
billionths, rounded down, at least 1.  Two sources differ by the sum of the
absolute differences over all kept terms; a source's own terms are those it
uses more than its language does.

The pair sums are rows of a sparse product, accumulated Gustavson's way.  The
kept terms are cut into blocks; a block's entries (group, term, count) stand
term-major, as an index.  For each group the block's task walks the group's
terms through that index and scatters what each posting tells into a dense
accumulator with one cell per source, so what leaves the task is one number per
pair of sources and block, never a pair of postings.  A scattered posting
corrects the baselines: a term that a source lacks has the share of count 0, so
for sources g and h with baselines b and each of their terms

    sum |p_g - p_h| = (V - n_g - n_h) |b_g - b_h| + S_g(h) + S_h(g)
                      + sum over shared terms of (|p_g - p_h| - |p_g - b_h| - |b_g - p_h| + |b_g - b_h|)

where S_g(h), the sum of |p_g - b_h| over g's terms, comes from g's sorted
shares and their running sums.  All numbers are integers.

Distribution: a task counts its texts in one dictionary of bounded size; the
counts are shuffled by (language, source, term) and then, one row per source,
by (language, term).  A block holds about ``block`` entries (or the square of
the sources' number, if that is more), so a language with a third of all rows
is many blocks.  A language's sources are held as one array (the pair part of
the result has their number squared in rows).

Defined results: NULL text, language and source are ''; a group without kept
terms has count 0 for all of them, and 0 to every other if its language keeps
none; repeated rows count each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .resample import BLOCK

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Different (group, term) pairs that a task remembers before it passes them on.
REMEMBERED = 300_000
#: Entries of a block of the term-major index; at least as many as a block can give out (pairs of sources).
ENTRIES = 50_000
#: Postings that a task scatters at a time.
SCATTERED = 1 << 20

# letters stay (a-z, all beyond ASCII), A-Z are lower-cased, the others part the terms
_TERM_BYTES = bytes(b if b in range(97, 123) or b > 127 else b + 32 if b in range(65, 91) else 32 for b in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _term_blocks(text: str, block: int = BLOCK) -> Iterator[list[bytes]]:
    raw = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + block) if start + block < len(raw) else -1
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` per task: occurrences, and documents that hold the term.

    Every group that occurs also has a row with a NULL term.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # group -> term -> [occurrences, documents]
        groups: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in groups.items():
                n = len(terms) + 1
                counts = np.array([*terms.values(), (0, 0)], np.int64).reshape(n, 2)
                names = pa.array([*terms, None], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), names,
                                                  pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())], schema=_COUNTED)
            groups.clear()

        for batch in batches:
            langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, lang, source in zip(batch.column(0), langs, sources):
                terms = groups[lang, source]
                held -= len(terms)
                own: dict[bytes, int] = {}
                for words in _term_blocks(text.as_py()):
                    for w in words:
                        own[w] = own.get(w, 0) + 1
                for w, n in own.items():
                    known = terms.get(w)
                    if known is None:
                        terms[w] = [n, 1]
                    else:
                        known[0] += n
                        known[1] += 1
                held += len(terms)
                if held > REMEMBERED:
                    yield from rows()
                    held = 0
        yield from rows()

    told = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*told).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per kept term: ``lang, term, total`` and ``postings``, an array of (source, n)."""
    return (counted.filter(F.col("term").isNotNull())
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                         F.collect_list(F.struct("source", "n")).alias("postings"))
            .filter(F.col("docs") >= min_docs).select("lang", "term", "total", "postings"))


def share_of(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly; 0 if there are no terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(2,0)"))
    below = total.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(2,0)") * terms.cast("decimal(12,0)")
    return F.when(terms > 0, F.call_function("div", top, below) + 1).otherwise(F.lit(0)).cast("long")


def group_totals(counted: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per group: ``lang, source, g, own_terms, total, terms, base``; one row per language)."""
    langs = (counted.select("lang").distinct()
             .join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total")), "lang", "left")
             .select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")))
    own = (kept.select("lang", F.explode("postings").alias("e"))
           .groupBy("lang", F.col("e.source").alias("source"))
           .agg(F.count(F.lit(1)).alias("own_terms"), F.sum("e.n").alias("total")))
    groups = (counted.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang")
              .select("lang", "source", F.coalesce("own_terms", F.lit(0)).alias("own_terms"),
                      F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total"))
    # a number for each source of a language: a cell of the accumulators
    cell = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return (groups.withColumn("g", cell)
            .withColumn("base", share_of(F.lit(0), F.col("total"), F.col("terms"))), langs)


def accumulate(block: pd.DataFrame) -> pd.DataFrame:
    """One block of a language's term-major index -> what shared terms add to each pair of sources (g, h).

    ``block`` has ``t`` (term), ``g``, ``p`` and ``base`` per entry.
    """
    lang = block["lang"].iloc[0]
    order = np.lexsort((block["g"].to_numpy(), block["t"].to_numpy()))
    g, p, base = (block[c].to_numpy(np.int64)[order] for c in ("g", "p", "base"))
    term = np.unique(block["t"].to_numpy(np.int64)[order], return_inverse=True)[1]
    first = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])  # term-major: the postings of each term
    rows = np.argsort(g, kind="stable")  # group-major: the terms of each group
    cells = int(g.max()) + 1
    out_g, out_h, out_v = [], [], []
    for row in np.split(rows, np.flatnonzero(np.diff(g[rows])) + 1):
        sums, touched = np.zeros(cells, np.int64), np.zeros(cells, bool)  # the dense accumulator of this group
        lengths = first[term[row] + 1] - first[term[row]]
        cuts = np.searchsorted(np.cumsum(lengths), np.arange(SCATTERED, int(lengths.sum()), SCATTERED))
        for part in np.split(np.arange(len(row)), np.unique(cuts)):
            if not len(part):
                continue
            n = lengths[part]
            start = first[term[row[part]]]
            at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            mine, b_mine = np.repeat(p[row[part]], n), base[row[0]]
            peer, b_peer = p[at], base[at]
            np.add.at(sums, g[at], np.abs(mine - peer) - np.abs(mine - b_peer) - np.abs(b_mine - peer) + np.abs(b_mine - b_peer))
            touched[g[at]] = True
        me = int(g[row[0]])
        touched[me] = False
        peers = np.flatnonzero(touched)
        out_g.append(np.full(len(peers), me))
        out_h.append(peers)
        out_v.append(sums[peers])
    out = pd.DataFrame({"g": np.concatenate(out_g), "h": np.concatenate(out_h), "value": np.concatenate(out_v)})
    out.insert(0, "lang", lang)
    return out


def _baselines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one group with its histogram of shares and its language's sources -> the baseline part of each pair."""
    for frame in batches:
        for r in frame.itertuples(index=False):
            peers = sorted((x["g"], x["base"], x["own_terms"]) for x in r.peers)
            base, own = (np.array([x[i] for x in peers], np.int64) for i in (1, 2))
            shares = sorted((x["p"], x["k"]) for x in (r.shares if r.shares is not None else ()))
            p, k = (np.array([x[i] for x in shares], np.int64) for i in (0, 1))
            many, sums = np.concatenate([[0], np.cumsum(k)]), np.concatenate([[0], np.cumsum(p * k)])
            low = np.searchsorted(p, base)  # shares below each baseline
            lacking = (base * many[low] - sums[low]) + (sums[-1] - sums[low]) - base * (many[-1] - many[low])
            neither = (r.terms - r.own_terms - own) * np.abs(r.base - base)
            h = np.arange(len(base))
            other = h != r.g
            # the term that g holds and h lacks counts for (g, h) and for (h, g)
            yield pd.DataFrame({"lang": r.lang, "g": np.concatenate([np.full(other.sum(), r.g), h[other]]),
                                "h": np.concatenate([h[other], np.full(other.sum(), r.g)]),
                                "value": np.concatenate([(lacking + neither)[other], lacking[other]])})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = ENTRIES) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language by distance (part ``pair``),
    and the ``top`` terms that the source uses more than its language (part ``term``)."""
    counted = stage(count_terms(docs).groupBy("lang", "source", "term")
                    .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = stage(kept_terms(counted, min_docs), "divergence-terms")
    groups, _ = group_totals(counted, kept)
    groups = stage(groups, "divergence-groups")
    entries = (kept.select("lang", "term", "total", F.explode("postings").alias("e"))
               .select("lang", "term", F.col("total").alias("in_lang"), F.col("e.source").alias("source"), F.col("e.n").alias("n"))
               .join(groups, ["lang", "source"])
               .withColumn("p", share_of(F.col("n"), F.col("total"), F.col("terms"))))
    entries = stage(entries.select("lang", "term", "in_lang", "source", "g", "p", "base", "terms", "lang_total"), "divergence-entries")

    # a language's terms are dealt to as many blocks as its entries ask for
    pairs_of = F.count(F.lit(1)) * F.count(F.lit(1))
    sizes = groups.groupBy("lang").agg(F.ceil(F.sum("own_terms") / F.greatest(F.lit(block), pairs_of)).alias("blocks"))
    term = F.xxhash64("term")
    blocks = (entries.join(sizes, "lang").select("lang", F.pmod(term, F.greatest("blocks", F.lit(1))).alias("part"),
                                                 "term", "g", "p", "base"))
    shared = (blocks.groupBy("lang", "part")
              .applyInPandas(lambda b: accumulate(b.assign(t=pd.factorize(b["term"])[0])), "lang string, g int, h int, value long"))
    shares = (entries.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("k"))
              .groupBy("lang", "g").agg(F.collect_list(F.struct("p", "k")).alias("shares")))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("g", "base", "own_terms")).alias("peers"))
    alone = (groups.select("lang", "g", "base", "own_terms", "terms").join(shares, ["lang", "g"], "left").join(peers, "lang")
             .mapInPandas(_baselines, "lang string, g int, h int, value long"))
    sums = shared.unionByName(alone).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("g"), "source")
    pairs = (sums.join(names, ["lang", "g"])
             .join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    own = (entries.withColumn("q", share_of(F.col("in_lang"), F.col("lang_total"), F.col("terms"))).filter(F.col("p") > F.col("q"))
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
           .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return pairs.unionByName(own)
