"""Checks whether quotes and numbers stand where they are said to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import numbers as nb
from foliant.functions import text as tx
from foliant.plans.shapes import contained_pairs, top_k
from foliant.session import broadcast_if_small, ensure_checkpoint_dir

#: Least length of a key that is looked for in the whole book.
ELSEWHERE_CHARS = 12


def page_keys(pages: DataFrame) -> DataFrame:
    """page_id, book, page_index and key of every page row that has letters."""
    # asked of the text: a condition on the key would make the key twice
    return pages.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select("page_id", "book", "page_index", tx.letters_key(F.col("text")).alias("key"))


def only_cited(pages: DataFrame, cited: DataFrame) -> DataFrame:
    """The pages of some places (book, page_index), by a broadcast of the places; all pages where they are too many, as a join would shuffle whole texts."""
    small = broadcast_if_small(cited)
    return pages if small is cited else pages.join(small, ["book", "page_index"], "left_semi")


def quote_status(checks: DataFrame, pages: DataFrame, least_words: int = 4) -> DataFrame:
    """check_id, status and pages of every quote with its cited page.

    Stages: bad-page (the book has no such page index), too-short, exact (on a row of the cited page, or running on to the next), wrong-page (elsewhere in
    the book, with up to three page indexes), not-found. Each stage sees only what the one before left, so that the costly search of the whole
    book runs for few quotes. Null quotes are too short.
    """
    q = checks.select("check_id", "book", "page_index", F.coalesce("quote", F.lit("")).alias("quote"))
    q = q.withColumn("qkey", tx.letters_key(F.col("quote"))).withColumn("words", tx.count_of(tx.one_line(F.col("quote")), r"\S+"))
    # scripts without spaces are long enough by characters
    wide = tx.count_of(F.col("quote"), r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]") * 2 > F.char_length("qkey")
    enough = ((F.col("words") >= least_words) & (F.char_length("qkey") >= 12)) | (wide & (F.char_length("qkey") >= 8))
    cited = pages.where("page_index IS NOT NULL").select("book", "page_index").distinct().withColumn("known", F.lit(True))
    ensure_checkpoint_dir(pages.sparkSession)
    q = q.select("check_id", "book", "page_index", "qkey", enough.alias("enough")).join(cited, ["book", "page_index"], "left").checkpoint()  # read many times below
    none = F.array().cast("array<int>")
    bad = q.where("known IS NULL").select("check_id", F.lit("bad-page").alias("status"), none.alias("pages"))
    short = q.where("known AND NOT enough").select("check_id", F.lit("too-short").alias("status"), none.alias("pages"))
    rest = q.where("known AND enough").select("check_id", "book", "page_index", "qkey")
    # keys of the cited pages and of those behind them only, where these are few; a quote runs on by no more than its own length
    here_at = rest.select("book", "page_index").distinct()
    longest = rest.agg(F.coalesce(F.max(F.char_length("qkey")), F.lit(0))).scalar()
    keys = page_keys(only_cited(pages, here_at))
    behind = page_keys(only_cited(pages, here_at.select("book", (F.col("page_index") + 1).alias("page_index"))))
    follow = behind.select("book", (F.col("page_index") - 1).alias("page_index"), F.substring("key", F.lit(1), longest).alias("spill"), F.col("page_id").alias("next_id"))
    one_next = follow.groupBy("book", "page_index").agg(F.min_by("spill", "next_id").alias("spill"))
    here = rest.join(keys.join(one_next, ["book", "page_index"], "left"), ["book", "page_index"])
    start = F.instr(F.concat("key", F.coalesce("spill", F.lit(""))), F.col("qkey"))
    exact = here.where((start > 0) & (start <= F.char_length("key"))).select("check_id").distinct().checkpoint()  # read three times below
    left = rest.join(exact, "check_id", "left_anti").checkpoint()
    pairs = contained_pairs(page_keys(pages), "page_id", "key", left, "check_id", "qkey", ELSEWHERE_CHARS, group="book")
    hits = pairs.join(pages.select("page_id", "book", "page_index"), ["page_id", "book"])
    found = hits.groupBy("check_id").agg(F.slice(F.array_sort(F.collect_set("page_index")), 1, 3).alias("pages"))
    wrong = found.select("check_id", F.lit("wrong-page").alias("status"), "pages")
    missing = left.join(found, "check_id", "left_anti").select("check_id", F.lit("not-found").alias("status"), none.alias("pages"))
    exact_rows = exact.select("check_id", F.lit("exact").alias("status"), none.alias("pages"))
    return bad.unionByName(short).unionByName(exact_rows).unionByName(wrong).unionByName(missing)


def least_edits(text: str, pattern: str) -> int:
    """Fewest insertions, deletions and exchanges that make the pattern of some stretch of the text; exact.

    The column of the edit table for every place of the text is held as two bit vectors of differences (vertical steps up and down), so that a place costs a few
    operations on whole numbers of as many bits as the pattern has characters.
    """
    m = len(pattern)
    if not m:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m
    best = m
    for c in text:
        equal = places.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        rises, falls = down | (every & ~(across | up)), up & across
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        rises, falls = (rises << 1) & every, (falls << 1) & every  # a match may start anywhere: the row above stays 0
        up, down = falls | (every & ~((equal | down) | rises)), rises & (equal | down)
    return best


def best_window(page_key: str | None, quote_key: str | None) -> float:
    """Likeness of the stretch of a page's key that is most like a quote's key: 1 less the edits for each character of the quote. Searches the whole page."""
    if not page_key or not quote_key:
        return 0.0
    return 1.0 - least_edits(page_key, quote_key) / len(quote_key)


def best_window_ratio(page_key: Column, quote_key: Column) -> Column:
    """best_window() of two columns, as an Arrow function."""

    @F.pandas_udf(T.DoubleType())
    def run(pages, quotes):
        import pandas as pd

        return pd.Series([best_window(p, q) for p, q in zip(pages, quotes)], dtype=float)

    return run(page_key, quote_key)


def fuzzy_quotes(checks: DataFrame, pages: DataFrame, status: DataFrame, approx: float = 0.94) -> DataFrame:
    """check_id, score and whether it is approximately right, for the quotes that were not found, on the rows of their cited page."""
    open_ids = status.where("status = 'not-found'").select("check_id")
    ensure_checkpoint_dir(pages.sparkSession)
    q = checks.join(open_ids, "check_id", "left_semi").select("check_id", "book", "page_index", tx.match_key(F.col("quote")).alias("qkey")).checkpoint()  # read twice below
    cited = only_cited(pages.where("text IS NOT NULL"), q.select("book", "page_index").distinct())
    near = q.join(cited.select("book", "page_index", "text"), ["book", "page_index"])  # keys in Python of cited pages only
    scored = near.select("check_id", best_window_ratio(tx.match_key(F.col("text")), F.col("qkey")).alias("score"))
    return scored.groupBy("check_id").agg(F.round(F.max("score"), 3).alias("score")).withColumn("approx", F.col("score") >= approx)


def number_support(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """check_id and the numbers of its quote that no row of the cited page states, in any reading."""
    q = checks.where("quote IS NOT NULL").select("check_id", "book", "page_index", nb.claim_numbers(F.col("quote")).alias("groups")).where("size(groups) > 0")
    allowed = pages.where("text IS NOT NULL").select("book", "page_index", F.explode(nb.numbers_in(F.col("text"))).alias("n"))
    allowed = allowed.groupBy("book", "page_index").agg(F.collect_set("n").alias("allowed"))
    both = q.join(allowed, ["book", "page_index"], "left")
    bare = lambda ns: F.array_union(ns, F.transform(ns, lambda n: F.regexp_replace(n, "^-", "")))
    missing = nb.unsupported(F.col("groups"), bare(F.coalesce("allowed", F.array().cast("array<string>"))))
    return both.select("check_id", F.size("groups").alias("numbers"), F.array_join(missing, ",").alias("unsupported"))


def words_of(text: Column) -> Column:
    """Distinct words of at least three letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), 0))


#: Pages whose words are held against all queries at once.
RANKED_PAGES = 16_384


def _hits(batch, wanted):
    """Of a batch of (page id, words): the row, the number in `wanted` and the count of each word of a row that is wanted, by row and number."""
    import numpy as np
    import pyarrow.compute as pc

    words = batch.column(1)
    number = pc.fill_null(pc.index_in(words.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    hit = number >= 0
    both, tf = np.unique(row[hit] * max(len(wanted), 1) + number[hit], return_counts=True)
    return both // max(len(wanted), 1), both % max(len(wanted), 1), tf


def _best_of_block(row, number, weight, pages: int, queries: list, least, k: int):
    """For each query, given as the sorted numbers of its words, the k best of the pages 0, 1, ... by rounded score and then by number: query, page, score.

    least: the k-th best score of each query so far; pages below it are left out, and it rises.
    """
    import numpy as np

    order = np.argsort(number, kind="stable")
    row, weight, number = row[order], weight[order], number[order]
    found = []
    for i, words in enumerate(queries):
        score = np.zeros(pages)
        for a, b in zip(np.searchsorted(number, words), np.searchsorted(number, words, "right")):
            score[row[a:b]] += weight[a:b]  # a page stands once for each word
        near = np.flatnonzero(score > max(least[i] - 1e-5, 0.0))
        if not len(near):
            continue
        rounded = np.round(score[near], 6)
        if len(near) > k:
            edge = np.partition(rounded, -k)[-k]
            above, level = np.flatnonzero(rounded > edge), np.flatnonzero(rounded == edge)
            best = np.concatenate([above, level[: k - len(above)]])
            near, rounded = near[best], rounded[best]
        if len(near) == k:
            least[i] = max(least[i], rounded.min())
        found.append((np.full(len(near), i), near, rounded))
    return [np.concatenate(x) for x in zip(*found)] if found else None


def rank_pages(queries: DataFrame, query_id: str, query_text: str, pages: DataFrame, k: int = 5) -> DataFrame:
    """The k pages most like each query by TF-IDF: query id, page_id, score and rank.

    Score: sum over the query's words of (1 + ln tf) * ln(1 + n / (1 + df)); pages with a positive score only. Every task holds its pages against all queries and
    hands on the k best of each, so that neither the words of pages nor the many pairs that share a word are shuffled. The words of pages are read
    twice, to count the pages of each word of a query and to score. Rows of one page id are one page.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ensure_checkpoint_dir(pages.sparkSession)
    asked = queries.where(F.col(query_text).isNotNull()).select(query_id, F.explode(words_of(F.col(query_text))).alias("word"))
    sets = asked.groupBy(query_id).agg(F.collect_set("word").alias("words")).toArrow()
    ids, words = sets.column(0).combine_chunks(), sets.column(1).combine_chunks()
    wanted = words.flatten().unique()
    rows = pages.where("text IS NOT NULL").select("page_id", "text")
    twice = rows.groupBy("page_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("page_id").alias("__twice")).checkpoint()
    body = rows
    if not twice.isEmpty():
        same, ids_twice = F.col("page_id").eqNullSafe(F.col("__twice")), broadcast_if_small(twice)
        whole = rows.join(ids_twice, same, "left_semi").groupBy("page_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
        body = rows.join(ids_twice, same, "left_anti").unionByName(whole)
    body = body.select("page_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{3,}"), 0).alias("words"))
    context = pages.sparkSession.sparkContext
    shared_words = context.broadcast(wanted)

    def count(batches):
        df = np.zeros(len(shared_words.value), np.int64)
        for batch in batches:
            df += np.bincount(_hits(batch, shared_words.value)[1], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["word", "df"])

    counted = body.mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    n = rows.count()
    idf = np.zeros(len(wanted))
    idf[counted.column(0).to_numpy()] = np.log(1 + n / (1 + counted.column(1).to_numpy()))
    # queries of the same words are scored once
    place = pc.index_in(words.flatten(), value_set=wanted).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
    alike: dict[tuple, list[int]] = {}
    for i, own in enumerate(np.split(place, ends[:-1]) if len(ids) else []):
        alike.setdefault(tuple(np.sort(own).tolist()), []).append(i)
    shared = context.broadcast((idf, ids, [np.array(x, np.int64) for x in alike], [np.array(x, np.int64) for x in alike.values()]))
    schema = T.StructType([queries.schema[query_id], pages.schema["page_id"], T.StructField("score", T.DoubleType())])

    def score(batches):
        idf, ids, asked, owners = shared.value
        least, held, size = np.zeros(len(asked)), [], 0

        def best():
            page = pa.chunked_array([x for x, *_ in held]).combine_chunks()
            order = pc.sort_indices(page).to_numpy()  # nulls last; equal scores go by page id
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row, number, tf = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            got = _best_of_block(rank[row], number, (1 + np.log(tf)) * idf[number], len(order), asked, least, k)
            if got:
                many = np.array([len(x) for x in owners])[got[0]]
                owner = np.concatenate([owners[i] for i in got[0]])
                columns = [ids.take(pa.array(owner)), page.take(pa.array(np.repeat(order[got[1]], many))), pa.array(np.repeat(got[2], many))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            row, number, tf = _hits(batch, shared_words.value)
            held.append((batch.column(0), row + size, number, tf))
            size += len(batch)
            if size >= RANKED_PAGES:
                yield from best()
                held, size = [], 0
        if size:
            yield from best()

    return top_k(body.mapInArrow(score, schema), [query_id], [F.col("score").desc(), F.col("page_id").asc_nulls_last()], k)
