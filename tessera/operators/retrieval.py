"""Retrieval: exact vector search, BM25 and raw lexical ranking, and their rank fusion, for any number of queries.

Queries and corpus are DataFrames. Vector search compares blocks: queries of bounded size go to every task of the corpus
scan, more of them meet it in a join of blocks (``operators.blocks``). A task keeps the best k per query of some ten thousand
vectors, and one window over these few rows gives the ranks. Lexical search works alike: an automaton finds all terms of a block in one
pass over each text, and a matrix product scores the texts inside the task. BM25 reads the corpus twice,
for its counts (document frequencies, number and length of the texts), summed up in the tasks, and for the scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import distinct_terms, segments
from tessera.operators.blocks import against
from tessera.sources.tables import written

QUERY_BLOCK_BYTES = 32 << 20
TERM_BLOCK_CHARS = 8 << 20
#: Bounds of the matrices of queries and terms, of texts and terms, and of queries and vectors.
FACTOR_CELLS = 4 << 20
TEXT_CELLS = 1 << 20
SCORE_CELLS = 1 << 20
#: Vectors that a task compares with all queries at once.
VECTOR_ROWS, VECTOR_BYTES = 1 << 16, 32 << 20
RRF_K = 60
K1, B = 1.2, 0.75
DIGITS = 6
Segmenter = Callable[[Column], Column]


def _ranked(scored: DataFrame, k: int, ascending: bool = False, by: str = "query_id", tie: list[str] | None = None) -> DataFrame:
    score = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(W.partitionBy(by).orderBy(score, *(tie or ["id"])))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", mismatch: str = "error", profile: str | None = None) -> DataFrame:
    """query_id, id, score, rank: the exact k best of ``corpus`` (id, vector) for each query (query_id, vector).

    ``metric``: cosine (zero norm: 0), clamped (norms of 1e-12 at least) or l2 (squared distance, ascending).
    ``mismatch``: vectors of another dimension are an ``error`` or score ``zero``. With ``profile``, a column of both,
    only vectors of the query's own profile are compared, null with null; all profiles share one scan of the corpus.
    Equal scores are ranked by id.
    """
    if metric not in ("cosine", "clamped", "l2") or mismatch not in ("error", "zero"):
        raise ValueError("metric is cosine, clamped or l2, mismatch is error or zero")
    id_type, query_type = corpus.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    id_kind, query_kind = to_arrow_type(corpus.schema["id"].dataType), to_arrow_type(queries.schema["query_id"].dataType)
    columns = ["id", "vector"] + ([] if profile is None else [profile])

    def search(block: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[tuple, list[int]] = {}
        for i, (_, vector, own) in enumerate(block):
            members.setdefault((own, len(vector)), []).append(i)
        factors = {g: np.array([block[i][1] for i in at], np.float64).reshape(len(at), g[1]) for g, at in members.items()}
        if not all(np.isfinite(q).all() for q in factors.values()):
            raise ValueError("a vector has a value that isn't finite")
        by_profile: dict[object, list[tuple]] = {}
        for g in members:
            by_profile.setdefault(g[0], []).append(g)
        names_of = {g: pa.array([block[i][0] for i in at], query_kind) for g, at in members.items()}
        for batch in _gathered(batches, VECTOR_ROWS, VECTOR_BYTES):
            names = [None] * batch.num_rows if profile is None else batch.column(2).to_pylist()
            rows: dict[object, list[int]] = {}
            for i, name in enumerate(names):
                if name in by_profile:
                    rows.setdefault(name, []).append(i)
            for name, at in rows.items():
                part = batch.take(pa.array(at))
                keys, column = part.column(0).cast(id_kind), part.column(1)
                places = np.empty(len(keys), np.int64)
                places[pc.array_sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(keys))
                sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
                for g in by_profile[name]:
                    same = sizes == g[1]
                    if mismatch == "error" and not same.all():
                        raise ValueError("query and stored vectors differ in dimension")
                    v = np.zeros((len(keys), g[1]))
                    v[same] = column.filter(pa.array(same)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, g[1])
                    if not np.isfinite(v).all():
                        raise ValueError("a vector has a value that isn't finite")
                    for at_query, at_key, scores in _best(factors[g], v, places, k, metric, same):
                        yield pa.RecordBatch.from_arrays([names_of[g].take(pa.array(at_query)), keys.take(pa.array(at_key)), pa.array(scores)], ["query_id", "id", "score"])

    own = queries.select("query_id", "vector", (F.lit(None).cast("string") if profile is None else F.col(profile)).alias("profile"))
    fits = lambda n, size: size <= QUERY_BLOCK_BYTES
    return _ranked(against(corpus.select(*columns), own, search, schema, fits, lambda q: 8 * len(q[1])), k, metric == "l2")


def _gathered(batches: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in as few of them as ``most`` rows and ``size`` bytes allow."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for whole in batches:
        step = max(1, min(most, whole.num_rows * size // max(whole.nbytes, 1)))
        for start in range(0, whole.num_rows, step):
            part = whole.slice(start, step)
            if held and (sum(b.num_rows for b in held) + part.num_rows > most or sum(b.nbytes for b in held) + part.nbytes > size):
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()


def _best(q: np.ndarray, v: np.ndarray, places: np.ndarray, k: int, metric: str, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of queries and of vectors, and scores: the best k of ``v`` for each of ``q``, equal ones by ``places``; of
    another dimension (not ``same``) 0.

    Cosines are estimated in single precision first; those that can be among the best by that are worked out in full.
    """
    n, size = len(v), min(k, len(v))
    if size <= 0:
        return
    nq, nv = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    least = {"cosine": 0, "clamped": 1e-12}.get(metric)
    some = np.concatenate([nq[nq > 0], nv[nv > 0]])
    estimated = least is not None and (not len(some) or some.min() > 1e-100)
    if estimated:
        unit = lambda x, norms: np.divide(x, np.maximum(norms, least)[:, None], out=np.zeros_like(x), where=np.maximum(norms, least)[:, None] > 0).astype(np.float32)
        q32, v32 = unit(q, nq), unit(v, nv).T
    margin = 1e-5 + 2e-7 * q.shape[1] if estimated else 10.0**-DIGITS
    width = min(64, n // (8 * size))
    step = max(1, SCORE_CELLS // n)
    for start in range(0, len(q), step):
        part = q[start : start + step]
        if estimated:
            found = q32[start : start + step] @ v32
        else:
            found = np.zeros((len(part), n))
            found[:, same] = _scores(part, v[same], metric)
            found = -found if metric == "l2" else found
        # The k-th best of the maxima of groups is no better than the k-th best of all.
        tops = found if width < 2 else found[:, : n // width * width].reshape(len(part), -1, width).max(2)
        bound = np.partition(tops, tops.shape[1] - size, axis=1)[:, tops.shape[1] - size]
        at_query, at_key = np.nonzero(found >= (bound - margin)[:, None])
        if estimated:
            dots, norms = np.empty(len(at_query)), np.maximum(nq[start + at_query], least) * np.maximum(nv[at_key], least)
            for i in range(0, len(dots), rows := max(1, SCORE_CELLS // max(q.shape[1], 1))):
                dots[i : i + rows] = np.einsum("ij,ij->i", part[at_query[i : i + rows]], v[at_key[i : i + rows]])
            scores = np.divide(dots, norms, out=np.zeros(len(dots)), where=norms > 0)
        else:
            scores = found[at_query, at_key] * (-1 if metric == "l2" else 1)
        scores = np.round(scores, DIGITS)
        order = np.lexsort((places[at_key], scores if metric == "l2" else -scores, at_query))
        at_query, at_key, scores = at_query[order], at_key[order], scores[order]
        first = np.searchsorted(at_query, np.arange(len(part)))
        kept = np.arange(len(at_query)) - first[at_query] < size
        yield start + at_query[kept], at_key[kept], scores[kept]


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0)
    nq, nv = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(v, axis=1)[None, :]
    if metric == "clamped":
        return (q @ v.T) / (np.maximum(nq, 1e-12) * np.maximum(nv, 1e-12))
    return np.divide(q @ v.T, nq * nv, out=np.zeros((len(q), len(v))), where=(nq * nv) > 0)


def _merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, keys: list, k: int, ascending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The best k scores and ids of each query so far, merged with ``scores`` (queries by ``keys``); equal scores go by id.

    A partition finds the k-th score first, so only what can still be among the best is sorted.
    """
    n = best[0].shape[1]
    every = np.concatenate([best[0], np.round(scores, DIGITS)], 1)
    size = min(k, every.shape[1])
    out_scores, out_ids = np.zeros((len(every), size)), np.zeros((len(every), size), object)
    for i, row in enumerate(every if ascending else -every):
        if not size:
            break
        near = np.flatnonzero(row <= np.partition(row, size - 1)[size - 1]).tolist()
        pick = sorted((row[j], best[1][i, j] if j < n else keys[j - n], j) for j in near)[:size]
        out_scores[i], out_ids[i] = every[i, [j for _, _, j in pick]], [name for _, name, _ in pick]
    return out_scores, out_ids


def every_profile_search(queries: DataFrame, corpus: DataFrame, k: int, profiles: int) -> DataFrame:
    """query_id, id, score, rank over vectors of all profiles, another dimension scoring 0: an id, which has at most one
    vector in each of ``profiles``, counts once, with its best score."""
    # Queries with equal vectors are searched for once.
    asked = written(queries.select("query_id", "vector"), "profile-queries")
    each = written(asked.select("vector").distinct().withColumn("each", F.monotonically_increasing_id()), "profile-vectors")
    hits = vector_search(each.select(F.col("each").alias("query_id"), "vector"), corpus, k * max(profiles, 1), "cosine", "zero")
    best = hits.select(F.col("query_id").alias("each"), "id", "score").join(asked.join(each, "vector").select("query_id", "each"), "each")
    return _ranked(best.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def store_search(queries: DataFrame, corpus: DataFrame, k: int, profile: str) -> DataFrame:
    """The vector store's search: inside a profile, strict dimensions, one row at least even for k = 0."""
    return vector_search(queries, corpus, max(k, 1), "cosine", "error", profile)


def query_term_rows(queries: DataFrame, terms: Segmenter = distinct_terms) -> DataFrame:
    """query_id, term, weight: how often a term stands in a query (query_id, text)."""
    each = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def automaton(words: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, w in enumerate(words):
        made.add_word(w, (i, len(w)))
    made.make_automaton()
    return made


def counted(finder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and number of non-overlapping occurrences, where there are any."""
    rows, spots, counts = [], [], []
    for row, text in enumerate(texts):
        tf: dict[int, int] = {}
        free: dict[int, int] = {}
        for end, (i, n) in finder.iter(text or ""):
            if end - n + 1 >= free.get(i, 0):
                tf[i] = tf.get(i, 0) + 1
                free[i] = end + 1
        spots += tf.keys()
        counts += tf.values()
        rows += [row] * len(tf)
    return np.array(rows, np.int64), np.array(spots, np.int64), np.array(counts, np.int64)


def _few_terms(n: int, chars: int) -> bool:
    return chars <= TERM_BLOCK_CHARS


def term_frequencies(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, id, tf: non-overlapping occurrences of each distinct ``term`` in ``corpus`` (id, text), where there are any."""
    schema = f"term string, id {corpus.schema['id'].dataType.simpleString()}, tf long"

    def search(words: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, names = automaton([w for (w,) in words]), pa.array([w for (w,) in words])
        for batch in batches:
            rows, spots, counts = counted(finder, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(spots)), batch.column("id").take(pa.array(rows)), pa.array(counts)], ["term", "id", "tf"])

    wanted = terms.where("term <> ''").select("term").distinct()
    return against(corpus.select("id", "text"), wanted, search, schema, _few_terms, lambda t: len(t[0]))


def corpus_counts(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, df, texts, chars, as a table: in how many texts each distinct term occurs, if in any.

    The row without a term has the number of all rows in df, and of the texts that aren't null and of their characters.
    Each task sums up what it finds, so one pass over the corpus gives all that BM25 has to know of it.
    """
    schema = "term string, df long, texts long, chars long"

    def search(words: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [w for (w,) in words if w is not None]
        finder, total, totals = automaton(own) if own else None, np.zeros(len(own), np.int64), len(own) < len(words)
        n = texts = chars = 0
        for batch in batches:
            column = batch.column("text")
            if totals:
                n, texts, chars = n + len(column), texts + len(column) - column.null_count, chars + (pc.sum(pc.utf8_length(column)).as_py() or 0)
            if finder is not None:
                _, spots, _ = counted(finder, column.to_pylist())
                total += np.bincount(spots, minlength=len(total))
        some = np.flatnonzero(total)
        zero = np.zeros(len(some), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()).take(pa.array(some)), pa.array(total[some]), pa.array(zero), pa.array(zero)], ["term", "df", "texts", "chars"])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *(pa.array([x], pa.int64()) for x in (n, texts, chars))], ["term", "df", "texts", "chars"])

    # The null among the terms asks for the totals, wherever it comes to stand.
    wanted = terms.where("term <> ''").select("term").distinct().unionByName(terms.sparkSession.createDataFrame([(None,)], "term string"))
    every = against(corpus.select("text"), wanted, search, schema, _few_terms, lambda t: len(t[0] or ""))
    return written(every.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "texts", "chars"))), "corpus-counts")


def _by_terms(wanted: DataFrame, corpus: DataFrame, k: int, mean: float | None = None) -> DataFrame:
    """query_id, id, score: each task's k best texts for each query (query_id, term, weight, idf) among those that hold a
    term: the sum of weight * idf * BM25's share of the occurrences with a ``mean`` length, or without of weight * occurrences.

    Queries are a matrix of queries and terms of bounded size; its product with the counts of a few texts gives their
    scores, so neither counts nor scores of single texts leave the task.
    """
    id_kind, query_kind = (to_arrow_type(df.schema[c].dataType) for df, c in ((corpus, "id"), (wanted, "query_id")))
    schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"

    def search(queries: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        cells = [(words.setdefault(t, len(words)), q, x) for q, (_, terms, values) in enumerate(queries) for t, x in zip(terms, values, strict=True)]
        finder, factors = automaton(list(words)), np.zeros((len(words), len(queries)))
        for t, q, x in cells:
            factors[t, q] = x
        best = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), object)
        step = max(1, TEXT_CELLS // max(len(words), len(queries)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                texts, keys = batch.column("text").to_pylist(), batch.column("id").to_pylist()
                rows, spots, counts = counted(finder, texts)
                values = counts.astype(np.float64)
                if mean is not None:
                    size = np.array([len(t or "") for t in texts])[rows]
                    values = values * (K1 + 1) / (values + K1 * (1 - B + B * size / mean))
                found = np.zeros((len(texts), len(words)))
                found[rows, spots] = values
                best = _merged(best, (found @ factors).T, keys, k)
        best_score, best_id = best
        q, j = np.nonzero(best_score > 0)
        yield pa.RecordBatch.from_arrays([pa.array([queries[i][0] for i in q], query_kind), pa.array(best_id[q, j].tolist(), id_kind), pa.array(best_score[q, j])], ["query_id", "id", "score"])

    each = F.sort_array(F.collect_list(F.struct("term", (F.col("weight") * F.col("idf")).alias("x"))))  # a query's own terms
    rows = wanted.where("term <> ''").groupBy("query_id").agg(each.alias("t")).select("query_id", "t.term", "t.x")
    fits = lambda n, terms: n * terms <= FACTOR_CELLS or n == 1
    return against(corpus.select("id", "text"), rows, search, schema, fits, lambda q: len(q[1]))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def term_statistics(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """term, doc_freq, idf of all distinct terms with the ``counts`` of a corpus, those that don't occur included."""
    n = counts.where("term IS NULL").agg(F.coalesce(F.max("df"), F.lit(0)).alias("n"))
    known = terms.select("term").distinct().join(counts.select("term", "df"), "term", "left").crossJoin(F.broadcast(n))  # n is one row
    df = F.coalesce("df", F.lit(0))
    return known.select("term", df.alias("doc_freq"), idf(F.col("n"), df).alias("idf"))


def bm25_search(queries: DataFrame, corpus: DataFrame, k: int, terms: Segmenter = segments, counts: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank by BM25 with lengths in characters; a term that a query repeats counts again.

    ``counts`` are those of the corpus for the queries' terms, if they are known already.
    """
    wanted = query_term_rows(queries, terms)
    counts = corpus_counts(wanted, corpus) if counts is None else counts
    size = counts.where("term IS NULL").agg((F.sum("chars") / F.nullif(F.sum("texts"), F.lit(0))).alias("mean")).first()
    return _ranked(_by_terms(wanted.join(term_statistics(wanted, counts), "term"), corpus, k, size.mean or 1.0), k)


def lexical_search(queries: DataFrame, corpus: DataFrame, k: int, terms: Segmenter = distinct_terms) -> DataFrame:
    """query_id, id, score, rank by the sum of the occurrences of a query's distinct terms."""
    wanted = query_term_rows(queries, terms).select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(1.0).alias("idf"))
    return _ranked(_by_terms(wanted, corpus, k), k)


def specificity(queries: DataFrame, stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, specificity, vector_weight, bm25_weight: the mean idf over 3, 1 at most; 0.5 for queries without terms."""
    mean = wanted.join(stats, "term").groupBy("query_id").agg((F.sum(F.col("idf") * F.col("weight")) / F.sum("weight")).alias("m"))
    own = queries.select("query_id").distinct().join(mean, "query_id", "left")
    s = F.least(F.coalesce(F.col("m") / 3.0, F.lit(0.5)), F.lit(1.0))
    return own.select("query_id", s.alias("specificity"), (1.0 - 0.6 * s).alias("vector_weight"), (0.4 + 0.8 * s).alias("bm25_weight"))


def analyze_queries(queries: DataFrame, corpus: DataFrame, terms: Segmenter = segments) -> DataFrame:
    """Per query and term: doc_freq and idf; per query: specificity and weights; formatted to three decimals."""
    wanted = query_term_rows(queries, terms)
    stats = term_statistics(wanted, corpus_counts(wanted, corpus))
    own = specificity(queries, stats, wanted)
    three = lambda c: F.format_string("%.3f", F.round(c, 3)).alias(c)
    rows = own.join(wanted, "query_id", "left").join(stats, "term", "left")
    return rows.select("query_id", "term", "doc_freq", three("idf"), three("specificity"), three("vector_weight"), three("bm25_weight"))


def fuse(lists: list[tuple[DataFrame, Column]], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank), each with its weight: sum of weight / (60 + rank)."""
    parts = [df.select("query_id", "id", (weight / (RRF_K + F.col("rank"))).alias("part")) for df, weight in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _ranked(every.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def hybrid_static(queries: DataFrame, corpus: DataFrame, k: int, terms: Segmenter = distinct_terms, texts: DataFrame | None = None) -> DataFrame:
    """Fusion of vector ranks (weight 0.8) and lexical ranks (weight 1), 3k candidates of each.

    ``texts`` (id, text) is the corpus without vectors, so that these aren't computed for the lexical side.
    """
    by_vector = vector_search(queries, corpus, 3 * k, "clamped")
    by_terms = lexical_search(queries, corpus if texts is None else texts, 3 * k, terms)
    return fuse([(by_vector, F.lit(0.8)), (by_terms, F.lit(1.0))], k)


def hybrid_adaptive(queries: DataFrame, corpus: DataFrame, k: int, terms: Segmenter = segments, texts: DataFrame | None = None) -> DataFrame:
    """Fusion of vector and BM25 ranks with weights by the query's specificity, 3k candidates of each; ``texts`` as above."""
    texts = corpus if texts is None else texts
    wanted = query_term_rows(queries, terms)
    counts = corpus_counts(wanted, texts)
    weights = specificity(queries, term_statistics(wanted, counts), wanted)
    by_vector = vector_search(queries, corpus, 3 * k, "cosine", "zero").join(weights, "query_id")
    by_terms = bm25_search(queries, texts, 3 * k, terms, counts).join(weights, "query_id")
    return fuse([(by_vector, F.col("vector_weight")), (by_terms, F.col("bm25_weight"))], k)


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The few hits with their chunks' columns; ``chunks`` has id."""
    return hits.join(chunks, "id")
