"""Registered queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import calc
from foliant.functions import numbers as nb
from foliant.functions import text as tx
from foliant.operators import evidence, integrity, inventory, notes, practice, ranking, structure, verification
from foliant.plans import shapes
from foliant.session import broadcast_if_small, read_table
from foliant.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}
AS_OF = "2026-06-30"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_WORDS = r"""len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '{cjk}', ' ', 'g'), '{no}', ' ', 'g'), '\S+'))""".format(cjk=tx.CJK, no=tx.NO_SPACES)


def _n(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_TOKENS = f"""CAST(floor((length(text) - {_n(tx.CJK)} - {_n(tx.INDIC)} - {_n(tx.SEMITIC)} - {_n(tx.CYRILLIC_GREEK)}) / CAST(4 AS DOUBLE) + {_n(tx.CJK)} * CAST(1.2 AS DOUBLE)
    + {_n(tx.INDIC)} * CAST(0.5 AS DOUBLE) + {_n(tx.SEMITIC)} * CAST(0.4 AS DOUBLE) + {_n(tx.CYRILLIC_GREEK)} * CAST(0.33 AS DOUBLE)) AS BIGINT) + 1"""


@query(
    f"""
SELECT doc_id,
  CASE WHEN text IS NOT NULL THEN CAST({_WORDS} + {_n(tx.CJK)} / 2.0 + {_n(tx.NO_SPACES)} / 3.0 AS DOUBLE) END AS n_words,
  {_TOKENS} AS n_tokens,
  CAST(length(text) AS BIGINT) AS n_chars FROM documents
"""
)
def doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Words, estimated tokens and characters of every document."""
    d, t = read_table(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", F.round(tx.word_count(t), 9).alias("n_words"), tx.estimate_tokens(t).alias("n_tokens"), F.char_length(t).cast("long").alias("n_chars"))


@query("SELECT page_id, sha256(" + "replace(" * 7 + "text" + "".join(f", '{a}', '{b}')" for a, b in tx.LIGATURES.items()) + ") AS digest FROM pages WHERE text IS NOT NULL")
def ligatures_fixed(spark, sf):
    return read_table(spark, sf, "pages").where("text IS NOT NULL").select("page_id", F.sha2(tx.fix_ligatures(F.col("text")), 256).alias("digest"))


@query(
    r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(title), '\([^)]*\)', ' ', 'g'), '[^\p{L}\p{N}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS s FROM documents),
b AS (SELECT doc_id, regexp_replace(substring(s, 1, 48), '^-+|-+$', '', 'g') AS s FROM a)
SELECT doc_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM b
"""
)
def title_slugs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", tx.slug(F.col("title")).alias("slug"))


@query(r"SELECT doc_id, sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS digest FROM documents")
def match_key_digest(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(tx.letters_key(F.col("text")), 256).alias("digest"))


@query()
def full_match_keys(spark, sf):
    """Match keys with compatibility forms and full case folding."""
    return read_table(spark, sf, "quote_checks").select("check_id", tx.match_key(F.col("quote")).alias("key"))


@query(
    r"""
WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS key FROM documents WHERE text IS NOT NULL)
SELECT substring(sha256(key), 1, 16) AS key, count(*) AS copies, min(doc_id) AS first_doc FROM k WHERE key != '' GROUP BY key HAVING count(*) > 1
"""
)
def exact_key_duplicates(spark, sf):
    """Groups of documents with one match key, by hash; members are doc ids with the same key."""
    k = read_table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", tx.letters_key(F.col("text")).alias("key")).where("key != ''")
    h = k.select("doc_id", F.sha2("key", 256).alias("h"))
    return h.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1").select(F.substring("h", 1, 16).alias("key"), "copies", "first_doc")


@query()
def number_readings(spark, sf):
    """Every number of every quote with its readings."""
    q = read_table(spark, sf, "quote_checks").where("quote IS NOT NULL")
    return q.select("check_id", F.posexplode(nb.number_groups(F.col("quote"))).alias("n", "g")).select("check_id", "n", F.array_join("g", "|").alias("readings"))


def _vote_sql() -> str:
    scripts = ", ".join(f"{_n(p)} * {w} AS s_{lang}" for lang, p, w in ranking.SCRIPTS)
    words = r"regexp_extract_all(lower(text), '[\p{L}]+')"
    votes = ", ".join(f"len(list_filter({words}, lambda w: list_contains([{', '.join(repr(x) for x in stop.split())}], w))) AS v_{lang}" for lang, stop in ranking.STOP_WORDS.items())
    top_s = "greatest(" + ", ".join(f"s_{lang}" for lang, _, _ in ranking.SCRIPTS) + ")"
    top_v = "greatest(" + ", ".join(f"v_{lang}" for lang in ranking.STOP_WORDS) + ")"
    case_s = " ".join(f"WHEN s_{lang} = {top_s} THEN '{lang}'" for lang, _, _ in ranking.SCRIPTS)
    case_v = " ".join(f"WHEN v_{lang} = {top_v} THEN '{lang}'" for lang in ranking.STOP_WORDS)
    return f"""SELECT doc_id, CASE WHEN {top_s} > 0 AND {top_s} * 2 > latin THEN CASE {case_s} END WHEN {top_v} > 0 THEN CASE {case_v} END ELSE 'en' END AS language
FROM (SELECT doc_id, {scripts}, {votes}, {_n('[A-Za-zÀ-ÿ]')} AS latin FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


@query(_vote_sql())
def language_vote(spark, sf):
    return ranking.language_vote(read_table(spark, sf, "documents"))


@query(f"SELECT lower(trim(d.lang)) AS lang, v.language, count(*) AS n FROM ({_vote_sql()}) v JOIN documents d USING (doc_id) GROUP BY ALL")
def language_confusion(spark, sf):
    """Counts of voted against given languages."""
    d = read_table(spark, sf, "documents")
    return ranking.language_vote(d).join(d.select("doc_id", F.lower(F.trim("lang")).alias("lang")), "doc_id").groupBy("lang", "language").agg(F.count("*").alias("n"))


_GARBLE = r"""
CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN CAST(0 AS DOUBLE) ELSE greatest(
  (len(regexp_extract_all(text, '\p{L}[\x{FFFD}\x{E000}-\x{F8E4}]|[\x{FFFD}\x{E000}-\x{F8E4}]\p{L}')) + len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))) / CAST(length(text) AS DOUBLE),
  CASE WHEN contains(text, '(cid:') THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END,
  CASE WHEN len(regexp_extract_all(text, '\p{L}')) >= 40 AND len(regexp_extract_all(text, '[À-ÖØ-öø-ÿ]')) > len(regexp_extract_all(text, '\p{L}')) * CAST(0.3 AS DOUBLE)
    THEN len(regexp_extract_all(text, '[À-ÖØ-öø-ÿ]')) / CAST(len(regexp_extract_all(text, '\p{L}')) AS DOUBLE) / 2 ELSE CAST(0 AS DOUBLE) END) END"""


@query(f"SELECT page_id, round({_GARBLE}, 6) AS ratio FROM pages")
def garble_ratios(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", F.round(tx.garble_ratio(F.col("text")), 6).alias("ratio"))


@query(f"SELECT coalesce(list_contains(flags, 'garbled'), false) AS flagged, coalesce({_GARBLE}, 0) > 0.01 AS found, count(*) AS n FROM pages GROUP BY ALL")
def flag_quality(spark, sf):
    """How the flag agrees with the measured ratio."""
    p = read_table(spark, sf, "pages")
    flagged = F.coalesce(F.array_contains("flags", "garbled"), F.lit(False))
    return p.select(flagged.alias("flagged"), (F.coalesce(tx.garble_ratio(F.col("text")), F.lit(0.0)) > 0.01).alias("found")).groupBy("flagged", "found").agg(F.count("*").alias("n"))


@query()
def page_quality_flags(spark, sf):
    return structure.page_flags(read_table(spark, sf, "pages"))


_CORE = r"regexp_replace(regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g'), ' '), '[0-9]+', '#', 'g'), '(^|[^\p{L}\p{N}])[ivxlcIVXLC]+($|[^\p{L}\p{N}])', '\1#\2', 'g')"
_LINES = r"lines AS (SELECT page_id, book, page_index, i - 1 AS line_no, l[i] AS line FROM (SELECT page_id, book, page_index, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pages WHERE text IS NOT NULL))"
_RUNNING = rf"""
filled AS (SELECT * FROM pages WHERE text IS NOT NULL AND regexp_matches(text, '[^ \n\t\r]')),
edge AS (SELECT *, min(line_no) OVER w AS lo, max(line_no) OVER w AS hi FROM lines WHERE trim(line, ' ') != '' AND page_id IN (SELECT page_id FROM filled) WINDOW w AS (PARTITION BY page_id)),
counted AS (SELECT book, {_CORE} AS core, count(DISTINCT page_index) AS pages FROM edge WHERE line_no = lo OR line_no = hi GROUP BY ALL),
sizes AS (SELECT book, count(DISTINCT page_index) AS book_pages FROM filled GROUP BY book),
running AS (SELECT c.book, core, pages, book_pages FROM counted c JOIN sizes s ON c.book = s.book WHERE pages >= 3 AND pages >= book_pages * CAST(0.2 AS DOUBLE))
"""


@query(f"WITH {_LINES}, {_RUNNING} SELECT book, core, pages, book_pages FROM running")
def running_lines(spark, sf):
    return structure.running_lines(read_table(spark, sf, "pages"))


@query(
    f"""WITH {_LINES}, {_RUNNING},
spots AS (SELECT *, {_CORE} AS core, min(line_no) FILTER (trim(line, ' ') != '') OVER w AS lo, max(line_no) FILTER (trim(line, ' ') != '') OVER w AS hi FROM lines WINDOW w AS (PARTITION BY page_id)),
kept AS (SELECT s.page_id, s.line_no, s.line, r.core IS NOT NULL AND (s.line_no = lo OR s.line_no = hi) AS dropped FROM spots s LEFT JOIN running r ON s.book = r.book AND s.core = r.core)
SELECT page_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(dropped, false)), '')) AS digest FROM kept GROUP BY page_id"""
)
def clean_pages(spark, sf):
    """Digest of every page without its running lines."""
    p = read_table(spark, sf, "pages")
    return structure.clean_text(p, structure.running_lines(p)).select("page_id", F.sha2("text", 256).alias("digest"))


@query(
    """
WITH n AS (SELECT DISTINCT book, page_index, CAST(label AS INTEGER) AS n FROM pages WHERE regexp_full_match(label, '[0-9]{1,6}') AND page_index IS NOT NULL),
v AS (SELECT book, n - page_index AS "offset", count(*) AS votes FROM n GROUP BY ALL), t AS (SELECT book, count(*) AS numbered FROM n GROUP BY book),
b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY votes DESC, "offset") AS r FROM v)
SELECT b.book, "offset", votes, numbered FROM b JOIN t ON b.book = t.book WHERE r = 1 AND votes >= 3 AND votes >= numbered * CAST(0.5 AS DOUBLE)
"""
)
def page_label_vote(spark, sf):
    return structure.label_offsets(read_table(spark, sf, "pages")).select("book", "offset", "votes", "numbered")


_PARAS = "paras_ AS (SELECT page_id, book, page_index, height, i - 1 AS pos, paras[i] AS p FROM (SELECT page_id, book, page_index, height, paras, unnest(range(1, len(paras) + 1)) AS i FROM pages))"


@query(
    f"""WITH {_PARAS}, s AS (SELECT book, p.size AS size, sum(length(p.text)) AS chars FROM paras_ WHERE p.size IS NOT NULL AND p.text IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chars DESC, size) AS r, sum(chars) OVER (PARTITION BY book) AS all_chars FROM s)
SELECT book, size AS body_size, CAST(chars AS BIGINT) AS chars, CAST(all_chars AS BIGINT) AS all_chars FROM b WHERE r = 1 AND all_chars > 2000"""
)
def body_sizes(spark, sf):
    return structure.body_sizes(read_table(spark, sf, "pages"))


@query(
    f"""WITH {_PARAS}, s AS (SELECT book, CAST(sum(coalesce(list_sum(list_transform(p.bold, lambda r: r[2] - r[1])), 0)) AS BIGINT) AS bold_chars, CAST(sum(length(p.text)) AS BIGINT) AS chars FROM paras_ WHERE p.text IS NOT NULL GROUP BY book)
SELECT book, bold_chars, chars, round(coalesce(bold_chars / CAST(nullif(chars, 0) AS DOUBLE), 0), 6) AS share, coalesce(bold_chars / CAST(nullif(chars, 0) AS DOUBLE), 0) > 0.45 AS meaningless FROM s"""
)
def bold_shares(spark, sf):
    return structure.bold_shares(read_table(spark, sf, "pages"))


@query()
def foot_notes(spark, sf):
    p = read_table(spark, sf, "pages")
    return structure.foot_notes(p, structure.body_sizes(p))


@query(
    rf"""WITH {_LINES}, h AS (SELECT book, page_index, page_id, line_no, regexp_extract(line, '^\s*(Figure|Fig\.|Table|Tab\.|Abbildung|Abb\.|Tabelle)\s+([0-9]+(?:\.[0-9]+)*)\s+(.*)$', ['k', 'n', 'c']) AS m FROM lines
  WHERE regexp_matches(line, '^\s*(Figure|Fig\.|Table|Tab\.|Abbildung|Abb\.|Tabelle)\s+([0-9]+(?:\.[0-9]+)*)\s+(.*)$')),
f AS (SELECT book, page_index, page_id, CASE WHEN regexp_matches(m.k, '^(Tab|Table)') THEN 'TAB-' ELSE 'FIG-' END || m.n AS figure, trim(regexp_replace(m.c, '\s+', ' ', 'g'), ' ') AS caption, line_no FROM h)
SELECT book, page_index, page_id, figure, caption FROM (SELECT *, row_number() OVER (PARTITION BY book, figure ORDER BY page_index NULLS FIRST, page_id, line_no) AS r FROM f) WHERE r = 1"""
)
def captions(spark, sf):
    return structure.captions(read_table(spark, sf, "pages"))


_OUTLINE = rf"""{_LINES}, h AS (SELECT book, page_index, page_id, line_no, regexp_extract(line, '^([0-9]{{1,2}}\.[0-9]{{1,2}}) +(\p{{Lu}}[^.!?=]{{2,70}})$', 1) AS section,
  trim(regexp_extract(line, '^([0-9]{{1,2}}\.[0-9]{{1,2}}) +(\p{{Lu}}[^.!?=]{{2,70}})$', 2), ' ') AS title FROM lines WHERE page_index IS NOT NULL AND regexp_matches(line, '^([0-9]{{1,2}}\.[0-9]{{1,2}}) +(\p{{Lu}}[^.!?=]{{2,70}})$')),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, section ORDER BY page_index, page_id, line_no) AS r FROM h) WHERE r = 1),
e AS (SELECT book, max(page_index) AS book_end FROM pages GROUP BY book),
sections AS (SELECT o.book, section, title, page_index AS first_page, greatest(page_index, coalesce(lead(page_index) OVER (PARTITION BY o.book ORDER BY page_index, page_id, line_no), book_end)) AS last_page FROM o JOIN e ON o.book = e.book)"""


@query(f"WITH {_OUTLINE} SELECT * FROM sections")
def outline(spark, sf):
    return structure.outline(read_table(spark, sf, "pages"))


@query(f"WITH {_OUTLINE} SELECT s.book, section, count(*) AS pages, min(page_id) AS first_id FROM sections s JOIN pages p ON s.book = p.book AND p.page_index BETWEEN first_page AND last_page GROUP BY ALL")
def section_ranges(spark, sf):
    """Pages of every section by a bucketed range join."""
    p = read_table(spark, sf, "pages")
    return structure.section_pages(p, structure.outline(p)).groupBy("book", "section").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_id"))


@query("WITH d AS (SELECT DISTINCT book, page_index AS v FROM pages WHERE page_index IS NOT NULL), r AS (SELECT *, v - row_number() OVER (PARTITION BY book ORDER BY v) AS g FROM d) SELECT book, min(v) AS first, max(v) AS last, count(*) AS size FROM r GROUP BY book, g")
def page_ranges(spark, sf):
    """Runs of delivered pages of every book."""
    return shapes.islands(read_table(spark, sf, "pages"), ["book"], "page_index")


@query()
def joined_line_ends(spark, sf):
    return structure.joined_line_ends(read_table(spark, sf, "pages"))


@query(
    r"""
WITH q AS (SELECT check_id, book, page_index, regexp_replace(lower(coalesce(quote, '')), '[^\p{L}\p{N}]', '', 'g') AS k, len(regexp_extract_all(trim(regexp_replace(coalesce(quote, ''), '\s+', ' ', 'g'), ' '), '\S+')) AS words,
  len(regexp_extract_all(coalesce(quote, ''), '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]')) AS wide FROM quote_checks),
known AS (SELECT DISTINCT book, page_index FROM pages WHERE page_index IS NOT NULL),
j AS (SELECT q.*, known.book IS NOT NULL AS cited, (words >= 4 AND length(k) >= 12) OR (wide * 2 > length(k) AND length(k) >= 8) AS enough FROM q LEFT JOIN known ON q.book = known.book AND q.page_index = known.page_index),
keys AS (SELECT page_id, book, page_index, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS key FROM pages WHERE text IS NOT NULL),
kk AS (SELECT * FROM keys WHERE key != ''),
spill AS (SELECT book, page_index - 1 AS page_index, arg_min(key, page_id) AS spill FROM kk GROUP BY ALL),
ex AS (SELECT DISTINCT check_id FROM (SELECT check_id, length(kk.key) AS n, instr(kk.key || coalesce(spill.spill, ''), j.k) AS spot FROM j JOIN kk ON j.book = kk.book AND j.page_index = kk.page_index
  LEFT JOIN spill ON kk.book = spill.book AND kk.page_index = spill.page_index WHERE cited AND enough) WHERE spot > 0 AND spot <= n),
wr AS (SELECT check_id, array_to_string(list_sort(list_distinct(list(kk.page_index)))[1:3], ',') AS pages FROM j JOIN kk ON j.book = kk.book AND contains(kk.key, j.k) WHERE cited AND enough AND length(j.k) >= 12 AND check_id NOT IN (SELECT check_id FROM ex) GROUP BY check_id)
SELECT j.check_id, CASE WHEN NOT cited THEN 'bad-page' WHEN NOT enough THEN 'too-short' WHEN ex.check_id IS NOT NULL THEN 'exact' WHEN wr.check_id IS NOT NULL THEN 'wrong-page' ELSE 'not-found' END AS status,
  coalesce(CASE WHEN cited AND enough AND ex.check_id IS NULL THEN wr.pages END, '') AS pages FROM j LEFT JOIN ex ON j.check_id = ex.check_id LEFT JOIN wr ON j.check_id = wr.check_id
"""
)
def quote_check(spark, sf):
    """Status of every quote: exact, wrong-page, not-found, bad-page or too-short."""
    s = evidence.quote_status(read_table(spark, sf, "quote_checks"), read_table(spark, sf, "pages"))
    return s.select("check_id", "status", F.array_join("pages", ",").alias("pages"))


@query()
def quote_fuzzy(spark, sf):
    """Likeness of the quotes that were not found to their cited page."""
    q, p = read_table(spark, sf, "quote_checks"), read_table(spark, sf, "pages")
    return evidence.fuzzy_quotes(q, p, evidence.quote_status(q, p))


@query()
def claim_number_support(spark, sf):
    return evidence.number_support(read_table(spark, sf, "quote_checks"), read_table(spark, sf, "pages"))


@query(
    r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS word FROM pages WHERE text IS NOT NULL),
q AS (SELECT DISTINCT check_id, unnest(regexp_extract_all(lower(quote), '[\p{L}\p{N}]{3,}')) AS word FROM quote_checks WHERE check_id % 50 = 0 AND quote IS NOT NULL),
tf AS (SELECT page_id, word, count(*) AS tf FROM t WHERE word IN (SELECT word FROM q) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
n AS (SELECT count(*) AS n FROM pages WHERE text IS NOT NULL),
s AS (SELECT check_id, page_id, round(sum((1 + ln(tf)) * ln(1 + n / CAST(1 + df AS DOUBLE))), 6) AS score FROM q JOIN tf ON q.word = tf.word JOIN df ON q.word = df.word, n GROUP BY ALL)
SELECT check_id, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY score DESC, page_id) AS rank FROM s) WHERE rank <= 5
"""
)
def tfidf_candidates(spark, sf):
    """The five pages most like each query, for every quote whose number is divisible by 50, against all pages."""
    q = read_table(spark, sf, "quote_checks").where("check_id % 50 = 0")
    return evidence.rank_pages(q, "check_id", "quote", read_table(spark, sf, "pages"))


@query()
def term_first_use(spark, sf):
    """First definition of every term in each book."""
    return inventory.first_uses(inventory.defined_terms(read_table(spark, sf, "pages")))


_DEFS = " UNION ALL ".join(
    f"SELECT page_id, book, page_index, trim(regexp_replace(term, '\\s+', ' ', 'g'), ' ') AS term FROM (SELECT page_id, book, page_index, unnest(regexp_extract_all(text, '{p}', 1)) AS term FROM pages WHERE text IS NOT NULL)"
    for _, p in inventory.DEFINING.values()
)
_FIRSTS = (
    f"t AS (SELECT *, regexp_replace(lower(term), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM ({_DEFS})),"
    " ok AS (SELECT * FROM t WHERE length(term) <= 60 AND len(regexp_extract_all(term, '\\S+')) <= 6 AND regexp_matches(term, '^\\p{L}') AND NOT regexp_matches(term, '(?i)^(?:figure|table|chapter|section|example|equation)\\b')),"
    " firsts AS (SELECT book, key, term, page_index, uses FROM (SELECT *, row_number() OVER (PARTITION BY book, key ORDER BY page_index NULLS LAST, page_id, term) AS r, count(*) OVER (PARTITION BY book, key) AS uses FROM ok) WHERE r = 1)"
)
ORACLES["term_first_use"] = f"WITH {_FIRSTS} SELECT * FROM firsts"
_OWNERS = "owners AS (SELECT key, book AS owner FROM (SELECT f.key, f.book, row_number() OVER (PARTITION BY key ORDER BY added_on NULLS LAST, f.book) AS r FROM firsts f LEFT JOIN (SELECT DISTINCT book, added_on FROM books) b ON f.book = b.book) WHERE r = 1)"


@query(f"WITH {_FIRSTS}, {_OWNERS} SELECT f.book, o.owner, count(*) AS weight FROM firsts f JOIN owners o ON f.key = o.key WHERE f.book != o.owner GROUP BY ALL HAVING count(*) >= 2")
def book_links(spark, sf):
    """Which books use terms that others own."""
    firsts = inventory.first_uses(inventory.defined_terms(read_table(spark, sf, "pages")))
    return inventory.book_links(firsts, inventory.term_owners(firsts, read_table(spark, sf, "books")))


@query()
def confusable_terms(spark, sf):
    return inventory.confusable_terms(inventory.first_uses(inventory.defined_terms(read_table(spark, sf, "pages"))))


@query(
    rf"""WITH {_LINES}, n AS (SELECT page_id, list(CAST(regexp_extract(line, '^([0-9]{{1,3}})\. ', 1) AS INTEGER) ORDER BY line_no) AS ns FROM lines WHERE regexp_matches(line, '^[0-9]{{1,3}}\. ') GROUP BY page_id)
SELECT page_id, CAST(len(ns) AS INTEGER) AS numbered, CAST(list_reduce(list_prepend(0, ns), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END) AS INTEGER) AS accepted FROM n"""
)
def exercise_numbering(spark, sf):
    """How many numbered items of a page continue the count from one."""
    return inventory.exercises(read_table(spark, sf, "pages"))


_SIGNALS = r"""
past AS (SELECT book, count(*) AS past FROM quote_checks GROUP BY book),
pp AS (SELECT book, count(DISTINCT page_index) AS pages, sum(len(regexp_extract_all(text, '(?m)^[0-9]{1,3}\. '))) AS exercises, sum(len(regexp_extract_all(text, '(?m)^Figure [0-9]'))) AS boxed, sum(len(regexp_extract_all(text, '\?'))) AS objectives FROM pages WHERE text IS NOT NULL GROUP BY book),
w AS (SELECT DISTINCT book, unnest(regexp_extract_all(lower(text), '[\p{L}]{9,}')) AS word FROM pages WHERE text IS NOT NULL),
te AS (SELECT book, count(*) AS terms FROM w GROUP BY book), sh AS (SELECT word FROM w GROUP BY word HAVING count(*) > 1), re AS (SELECT book, count(*) AS reuse FROM w WHERE word IN (SELECT word FROM sh) GROUP BY book),
sg AS (SELECT b.book, coalesce(pages, 0) AS pages, coalesce(past, 0) AS past, coalesce(objectives, 0) AS objectives, coalesce(exercises, 0) AS exercises, coalesce(reuse, 0) AS reuse, coalesce(terms, 0) AS terms, coalesce(boxed, 0) AS boxed
  FROM (SELECT DISTINCT book FROM books) b LEFT JOIN past ON b.book = past.book LEFT JOIN pp ON b.book = pp.book LEFT JOIN te ON b.book = te.book LEFT JOIN re ON b.book = re.book),
sc AS (SELECT *, round(""" + " + ".join(f"coalesce({c} / CAST(nullif(max({c}) OVER (), 0) AS DOUBLE), 0) * CAST({w} AS DOUBLE)" for c, w in ranking.WEIGHTS.items()) + r""", 6) AS score FROM sg),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, book) AS INTEGER) AS rank, count(*) OVER () AS n FROM sc),
plan AS (SELECT *, CASE WHEN rank <= round_even(n * CAST(0.3 AS DOUBLE), 0) THEN 3 WHEN rank <= round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 2 ELSE 1 END AS stars FROM rk)
"""


@query(f"WITH {_SIGNALS} SELECT book, score, rank, stars, CAST(pages AS BIGINT) AS pages, CAST(round_even(greatest(15, pages * 7) * CASE stars WHEN 3 THEN CAST(1.2 AS DOUBLE) WHEN 2 THEN 1 ELSE CAST(0.7 AS DOUBLE) END, 0) AS BIGINT) AS minutes FROM plan")
def priority_plan(spark, sf):
    """Books by study priority."""
    return ranking.priority_plan(read_table(spark, sf, "books"), read_table(spark, sf, "pages"), read_table(spark, sf, "quote_checks"))


@query(
    f"""WITH {_SIGNALS}, m AS (SELECT book, CAST(round_even(greatest(15, pages * 7) * CASE stars WHEN 3 THEN CAST(1.2 AS DOUBLE) WHEN 2 THEN 1 ELSE CAST(0.7 AS DOUBLE) END, 0) AS BIGINT) AS minutes, rank FROM plan),
s AS (SELECT book, minutes, sum(minutes) OVER (ORDER BY rank) AS hi FROM m WHERE minutes > 0), d AS (SELECT *, hi - minutes AS lo FROM s),
x AS (SELECT book, hi, lo, unnest(range(CAST(floor(lo / CAST(120 AS DOUBLE)) AS BIGINT), CAST(ceil(hi / CAST(120 AS DOUBLE)) AS BIGINT))) AS day0 FROM d)
SELECT book, CAST(day0 + 1 AS INTEGER) AS day, CAST(least(hi, (day0 + 1) * 120) - greatest(lo, day0 * 120) AS BIGINT) AS minutes FROM x"""
)
def learn_fill(spark, sf):
    """Books spread over days of two hours in order of priority."""
    return practice.fill_days(priority_plan(spark, sf), ["book"], "minutes", [F.col("rank")])


@query(f"WITH {_FIRSTS}, {_SIGNALS} SELECT f.book, f.key, CAST(least(3, stars + CASE WHEN uses > 1 THEN 1 ELSE 0 END) AS INTEGER) AS stars FROM firsts f LEFT JOIN plan ON f.book = plan.book")
def item_stars(spark, sf):
    """Stars of every term: those of its book, one more if it is defined more than once."""
    firsts = inventory.first_uses(inventory.defined_terms(read_table(spark, sf, "pages")))
    both = firsts.join(priority_plan(spark, sf).select("book", "stars"), "book", "left")
    return both.select("book", "key", F.least(F.lit(3), F.col("stars") + (F.col("uses") > 1).cast("int")).alias("stars"))


_FIELDS = r"f AS (SELECT block_no, kind, i - 1 AS field_no, regexp_replace(lower(trim(regexp_replace(fields[i].key, '\s+', ' ', 'g'), ' ')), '\s*_\s*', '-', 'g') AS key, fields[i].value AS value FROM (SELECT block_no, kind, fields, unnest(range(1, len(fields) + 1)) AS i FROM note_blocks))"


@query(f"WITH {_FIELDS} SELECT kind, key, count(*) AS n, count(value) AS filled FROM f GROUP BY ALL")
def field_census(spark, sf):
    """How often every field occurs in each kind of block."""
    return notes.fields(read_table(spark, sf, "note_blocks")).groupBy("kind", "key").agg(F.count("*").alias("n"), F.count("value").alias("filled"))


@query(
    rf"""WITH {_FIELDS}, c AS (SELECT block_no, field_no, regexp_extract_all(value, '\[p\.?\s*([^:\]"]+):\s*"([^"]*)"\s*\]', 1) AS ps, regexp_extract_all(value, '\[p\.?\s*([^:\]"]+):\s*"([^"]*)"\s*\]', 2) AS qs FROM f WHERE value IS NOT NULL)
SELECT block_no, CAST(field_no AS INTEGER) AS field_no, CAST(i - 1 AS INTEGER) AS n, trim(ps[i], ' ') AS page, qs[i] AS quote FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM c)"""
)
def note_citations(spark, sf):
    """Every citation of every field."""
    return notes.cited(notes.fields(read_table(spark, sf, "note_blocks")))


def _rules_sql() -> str:
    rows = []
    for entry in notes.RULES.replace("\n", "|").split("|"):
        p = entry.split()
        if p:
            rows.append(f"('{p[0]}', '{' '.join(p[1:-3])}', {p[-3]}, {p[-2]}, {p[-1]})")
    return f"r AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t(kind, key, least_, most_, words_))"


@query(
    rf"""WITH {_FIELDS}, {_rules_sql()}, c AS (SELECT block_no, kind, key, count(*) AS n FROM f GROUP BY ALL),
bare AS (SELECT block_no, kind, key, len(regexp_extract_all(regexp_replace(regexp_replace(value, '\[p\.?\s*[^\]]*\]', ' ', 'g'), '\(covers:\s*([^)]*)\)', ' ', 'g'), '\S+')) AS words FROM f WHERE value IS NOT NULL)
SELECT b.block_no, r.key, 'missing' AS code FROM note_blocks b JOIN r ON b.kind = r.kind WHERE least_ > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.block_no = b.block_no AND c.key = r.key)
UNION ALL SELECT block_no, c.key, 'too-many' FROM c JOIN r ON c.kind = r.kind AND c.key = r.key WHERE most_ > 0 AND n > most_
UNION ALL SELECT block_no, c.key, 'unknown' FROM c WHERE key IS NOT NULL AND kind IN (SELECT kind FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE r.kind = c.kind AND r.key = c.key)
UNION ALL SELECT DISTINCT block_no, key, 'empty' FROM f WHERE value IS NULL OR trim(value, ' ') = ''
UNION ALL SELECT DISTINCT block_no, bare.key, 'too-long' FROM bare JOIN r ON bare.kind = r.kind AND bare.key = r.key WHERE words_ > 0 AND words > words_"""
)
def lint_issues(spark, sf):
    """Broken rules of all note blocks."""
    return notes.issues(read_table(spark, sf, "note_blocks"))


@query()
def lint_formulas(spark, sf):
    return notes.formula_issues(notes.fields(read_table(spark, sf, "note_blocks")))


@query(
    rf"""WITH {_FIELDS}, q AS (SELECT block_no, arg_min(trim(value, ' '), field_no) FILTER (key = 'type') AS type, arg_min(trim(value, ' '), field_no) FILTER (key = 'answer') AS answer,
  array_to_string(list_sort(list_distinct(list(upper(substring(key, 8, 1))) FILTER (regexp_full_match(key, 'option [a-d]')))), '') AS options FROM f WHERE kind = 'question' AND value IS NOT NULL GROUP BY block_no)
SELECT block_no, type, answer, coalesce(options, '') AS options, CASE WHEN type = 'mcq' THEN contains(coalesce(options, ''), upper(substring(answer, 1, 1))) AND length(answer) = 1 WHEN type = 'tf' THEN lower(answer) IN ('true', 'false') WHEN type IN ('numeric', 'cloze') THEN answer != '' END AS valid FROM q"""
)
def answer_check(spark, sf):
    """Validity of the answers of questions; null where a reader has to judge."""
    return notes.answer_issues(read_table(spark, sf, "note_blocks"))


@query()
def calc_checks(spark, sf):
    """Calculation lines of notes and whether they come out as stated; the lines of a block are run in order, later ones know the names of earlier ones."""
    return notes.calculations(read_table(spark, sf, "note_blocks"))


@query()
def unit_conversions(spark, sf):
    """Factors of the units that quantities of the pages carry."""
    units = read_table(spark, sf, "pages").where("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9] ([A-Za-zµΩÅ°/]{1,8}[²³]?)(?=[\s.,;)])"), 1)).alias("unit"))
    counted = units.groupBy("unit").agg(F.count("*").alias("n"))
    return counted.withColumn("u", calc.unit_factor(F.col("unit"))).where("u.factor IS NOT NULL").select("unit", "n", F.col("u.factor").alias("factor"), F.array_join(F.transform("u.dims", lambda d: d.cast("int").cast("string")), " ").alias("dims"))


_MUT = r"""
p AS (SELECT book, page_index, string_agg(text, chr(10) ORDER BY page_id) AS context FROM pages WHERE text IS NOT NULL GROUP BY ALL),
c AS (SELECT check_id, quote, p.context AS context, regexp_extract(quote, '([0-9]+)', 1) AS number FROM quote_checks q LEFT JOIN p ON q.book = p.book AND q.page_index = p.page_index WHERE quote IS NOT NULL),
m AS (SELECT *, CASE WHEN length(number) >= 2 AND substring(number, -1, 1) != substring(number, -2, 1) THEN substring(number, 1, length(number) - 2) || substring(number, -1, 1) || substring(number, -2, 1)
  ELSE substring(number, 1, length(number) - 1) || CASE WHEN substring(number, -1, 1) = '9' THEN '8' ELSE CAST(CAST(substring(number, -1, 1) AS INTEGER) + 1 AS VARCHAR) END END AS changed FROM c WHERE number != ''),
planted AS (SELECT check_id, number, changed, regexp_extract(quote, '^([^0-9]*)', 1) || changed || regexp_extract(quote, '(?s)^[^0-9]*[0-9]+(.*)$', 1) AS mutated FROM m WHERE NOT coalesce(contains(context, changed), false))
"""


def _planted(spark, sf):
    q, p = read_table(spark, sf, "quote_checks"), read_table(spark, sf, "pages").where("text IS NOT NULL")
    p = p.join(broadcast_if_small(q.select("book", "page_index").distinct()), ["book", "page_index"], "left_semi")  # cited pages only
    context = p.groupBy("book", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "text"))), lambda x: x["text"]), "\n").alias("page_context"))
    return verification.false_numbers(q.join(context, ["book", "page_index"], "left"), "check_id", "quote", "page_context")


@query(f"WITH {_MUT} SELECT * FROM planted")
def mutate_numbers(spark, sf):
    """Quotes with a wrong number that their page does not hold."""
    return _planted(spark, sf)


def _words_sql() -> str:
    """The first word of the table that a quote holds as a word of its own, its opposite, and the quote with every such word exchanged."""
    pairs = [(a, b) for table in verification.ANTONYMS.values() for x, y in table for a, b in ((x, y), (y, x))]
    edge = r"[^\p{L}\p{N}]"
    case = lambda then: "CASE " + " ".join(f"WHEN regexp_matches(quote, '(?:^|{edge}){a}(?:{edge}|$)') THEN {then(a, b)}" for a, b in pairs) + " END"
    # neighbours share the mark between them, so that the second pass takes every other one
    once = lambda text, a, b: f"regexp_replace({text}, '(^|{edge}){a}($|{edge})', '\\1{b}\\2', 'g')"
    word, opposite, mutated = case(lambda a, b: f"'{a}'"), case(lambda a, b: f"'{b}'"), case(lambda a, b: once(once("quote", a, b), a, b))
    return f"SELECT * FROM (SELECT check_id, {word} AS word, {opposite} AS opposite, {mutated} AS mutated FROM quote_checks WHERE quote IS NOT NULL) WHERE word IS NOT NULL"


@query(_words_sql())
def mutate_words(spark, sf):
    """Quotes with a word put into its opposite."""
    return verification.false_words(read_table(spark, sf, "quote_checks").where("quote IS NOT NULL"), "check_id", "quote")


@query(f"WITH {_MUT} SELECT count(*) AS planted, count(*) FILTER (NOT list_contains(regexp_extract_all(coalesce(p.context, ''), '[0-9]+'), changed)) AS caught FROM planted JOIN quote_checks q USING (check_id) LEFT JOIN p ON q.book = p.book AND q.page_index = p.page_index")
def mutation_catch_rate(spark, sf):
    """Planted wrong numbers that a check against the page's numbers catches."""
    q, p = read_table(spark, sf, "quote_checks"), read_table(spark, sf, "pages").where("text IS NOT NULL")
    numbers = p.select("book", "page_index", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("n")).distinct()
    planted = _planted(spark, sf).join(q.select("check_id", "book", "page_index"), "check_id")
    seen = numbers.select("book", "page_index", F.col("n").alias("changed"))
    missed = seen.withColumn("missed", F.lit(1))
    judged = planted.join(missed, ["book", "page_index", "changed"], "left")
    return judged.agg(F.count("*").alias("planted"), (F.count("*") - F.count("missed")).alias("caught"))


@query("SELECT check_id, book, CAST(ceil(n / CAST(12 AS DOUBLE)) AS INTEGER) AS batch, CAST((n - 1) % 12 + 1 AS INTEGER) AS place FROM (SELECT check_id, book, row_number() OVER (PARTITION BY book ORDER BY check_id) AS n FROM quote_checks)")
def claim_batches(spark, sf):
    return verification.batches(read_table(spark, sf, "quote_checks").select("check_id", "book"), ["book"], [F.col("check_id")])


@query(
    """WITH b AS (SELECT book, status, check_id, CAST(ceil(row_number() OVER (PARTITION BY book ORDER BY check_id) / CAST(12 AS DOUBLE)) AS INTEGER) AS batch FROM quote_checks),
j AS (SELECT *, substring(sha256(CAST(check_id AS VARCHAR)), 1, 1) IN ('0', '1') AS planted, coalesce(status = 'exact', false) AS v FROM b)
SELECT book, batch, count(*) AS claims, CAST(sum(CAST(planted AS INTEGER)) AS BIGINT) AS planted, CAST(sum(CAST(planted AND NOT v AS INTEGER)) AS BIGINT) AS caught, bool_or(planted AND v) AS rejected FROM j GROUP BY book, batch"""
)
def batch_scores(spark, sf):
    """Scores of batches in which an eighth of the claims count as planted and the stored status as verdict."""
    b = verification.batches(read_table(spark, sf, "quote_checks").select("check_id", "book", "status"), ["book"], [F.col("check_id")])
    j = b.withColumn("planted", F.substring(F.sha2(F.col("check_id").cast("string"), 256), 1, 1).isin("0", "1")).withColumn("verdict_true", F.coalesce(F.col("status") == "exact", F.lit(False)))
    return verification.batch_scores(j, ["book", "batch"])


@query("SELECT book, status, count(*) AS n FROM quote_checks GROUP BY GROUPING SETS ((book, status), (status))")
def trust_counts(spark, sf):
    """Stored statuses by book and over all."""
    return verification.status_rollup(read_table(spark, sf, "quote_checks").select("book", "status"))


@query()
def mismatched_context(spark, sf):
    """For each quote a page that it does not fit."""
    q = read_table(spark, sf, "quote_checks").where("quote IS NOT NULL").select("check_id", tx.letters_key(F.col("quote")).alias("key"))
    p = evidence.page_keys(read_table(spark, sf, "pages")).select("page_id", F.col("key").alias("page_key"))
    return verification.mismatched(q, "check_id", "key", p, "page_id", "page_key")


@query(
    f"WITH {_FIRSTS}, q AS (SELECT DISTINCT book, unnest(regexp_extract_all(lower(quote), '[\\p{{L}}]+')) AS word FROM quote_checks WHERE quote IS NOT NULL), c AS (SELECT f.book, f.key, EXISTS (SELECT 1 FROM q WHERE q.book = f.book AND q.word = f.key) AS covered FROM firsts f)"
    " SELECT book, count(*) AS terms, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered) / CAST(count(*) AS DOUBLE), 6) AS share FROM c GROUP BY book"
)
def coverage_report(spark, sf):
    """Terms of every book that a quote from it names as a word."""
    firsts = inventory.first_uses(inventory.defined_terms(read_table(spark, sf, "pages"))).select("book", "key")
    q = read_table(spark, sf, "quote_checks").where("quote IS NOT NULL").select("book", F.explode(F.regexp_extract_all(F.lower("quote"), F.lit(r"[\p{L}]+"), 0)).alias("key")).distinct()
    both = firsts.join(q.withColumn("hit", F.lit(1)), ["book", "key"], "left")
    return both.groupBy("book").agg(F.count("*").alias("terms"), F.count("hit").alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("terms"), 6))


@query(
    "WITH d AS (SELECT book, page_index, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest, row_number() OVER (PARTITION BY book, page_index ORDER BY page_id) AS a, row_number() OVER (PARTITION BY book, page_index ORDER BY page_id DESC) AS z, count(*) OVER (PARTITION BY book, page_index) AS n FROM pages WHERE page_index IS NOT NULL),"
    " o AS (SELECT * FROM d WHERE a = 1), w AS (SELECT * FROM d WHERE z = 1 AND n > 1) SELECT coalesce(o.book, w.book) AS book, coalesce(o.page_index, w.page_index) AS page_index, CASE WHEN w.book IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN w ON o.book = w.book AND o.page_index = w.page_index WHERE w.book IS NULL OR o.digest IS DISTINCT FROM w.digest"
)
def integrity_diff(spark, sf):
    """First deliveries of pages against last ones of those delivered again."""
    from pyspark.sql import Window

    p = read_table(spark, sf, "pages").where("page_index IS NOT NULL")
    w = Window.partitionBy("book", "page_index")
    ranked = p.select("book", "page_index", "text", F.row_number().over(w.orderBy("page_id")).alias("a"), F.row_number().over(w.orderBy(F.desc("page_id"))).alias("z"), F.count("*").over(w).alias("n"))
    keys = ["book", "page_index"]
    return integrity.changes(integrity.digests(ranked.where("a = 1"), keys, "text"), integrity.digests(ranked.where("z = 1 AND n > 1"), keys, "text"), keys)


_RESULTS = "d AS (SELECT DISTINCT ON (result_no) result_no, course, id, correct, \"at\" FROM study_results WHERE \"at\" IS NOT NULL AND correct IS NOT NULL AND id IS NOT NULL)"
_STATE = f"""{_RESULTS}, h AS (SELECT course, id, list({{'d': CAST("at" AS DATE), 'c': correct}} ORDER BY "at", result_no) AS hs FROM d GROUP BY ALL),
r AS (SELECT course, id, len(hs) AS answers, list_reduce(list_prepend({{'box': CAST(NULL AS INTEGER), 'due': CAST(NULL AS DATE), 'streak': 0, 'learned': false, 'd': CAST(NULL AS DATE), 'c': false}},
  list_transform(hs, lambda x: {{'box': CAST(NULL AS INTEGER), 'due': CAST(NULL AS DATE), 'streak': 0, 'learned': false, 'd': x.d, 'c': x.c}})), lambda a, x: {{
    'box': CASE WHEN NOT x.c THEN 0 WHEN a.due IS NOT NULL THEN least(coalesce(a.box, 0) + 1, 3) ELSE a.box END,
    'due': CASE WHEN NOT x.c THEN x.d + 1 WHEN a.due IS NOT NULL AND a.streak + 1 >= 3 THEN NULL WHEN a.due IS NOT NULL THEN x.d + [1, 3, 7, 14][least(coalesce(a.box, 0) + 1, 3) + 1] ELSE a.due END,
    'streak': CASE WHEN x.c THEN a.streak + 1 ELSE 0 END,
    'learned': CASE WHEN NOT x.c THEN false WHEN a.due IS NOT NULL AND a.streak + 1 >= 3 THEN true ELSE a.learned END, 'd': x.d, 'c': x.c}}) AS s FROM h),
states AS (SELECT course, id, s.box AS box, CAST(s.due AS DATE) AS due, CAST(s.streak AS INTEGER) AS streak, s.learned AS learned, CAST(answers AS INTEGER) AS answers FROM r)"""


@query(f"WITH {_STATE} SELECT * FROM states")
def relearn_state(spark, sf):
    """State of every question after all its answers."""
    return practice.relearning(practice.distinct_results(read_table(spark, sf, "study_results")), ["course", "id"])


@query(f"WITH {_STATE} SELECT course, id, box, due FROM states WHERE due <= DATE '{AS_OF}' AND NOT learned")
def relearn_due(spark, sf):
    """Questions due on a day."""
    return practice.due_questions(relearn_state(spark, sf), F.lit(AS_OF).cast("date")).select("course", "id", "box", "due")


@query(
    f"""WITH {_RESULTS}, c AS (SELECT *, coalesce(CAST(correct != lag(correct) OVER w AS INTEGER), 1) AS ch FROM d WINDOW w AS (PARTITION BY course, id ORDER BY "at", result_no)),
s AS (SELECT *, sum(ch) OVER (PARTITION BY course, id ORDER BY "at", result_no ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT course, id, CAST(run AS BIGINT) AS run, bool_and(correct) AS correct, count(*) AS answers, min("at") AS first_at, max("at") AS last_at FROM s GROUP BY course, id, run"""
)
def answer_streaks(spark, sf):
    """Runs of right and wrong answers."""
    return practice.streaks(practice.distinct_results(read_table(spark, sf, "study_results")), ["course", "id"])


@query(
    f"""WITH {_RESULTS}, l AS (SELECT course, id, CAST(min("at") AS DATE) AS day FROM d GROUP BY ALL), e AS (SELECT *, unnest([1, 3, 7, 14, 30]) AS gap FROM l)
SELECT course, id, gap, CASE WHEN dayofweek(day + gap) = 0 THEN day + gap + 1 ELSE day + gap END AS review_on FROM e"""
)
def review_schedule(spark, sf):
    """Review days of every question after its first answer, none on Sundays."""
    first = practice.distinct_results(read_table(spark, sf, "study_results")).groupBy("course", "id").agg(F.to_date(F.min("at")).alias("day"))
    return practice.reviews(first, ["course", "id"], "day")


@query(
    f"""WITH {_RESULTS}, g AS (SELECT *, CASE WHEN "at" - lag("at") OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM d WINDOW w AS (PARTITION BY course ORDER BY "at", result_no)),
s AS (SELECT *, sum(n) OVER (PARTITION BY course ORDER BY "at", result_no ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT course, count(*) AS answers, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS "right", min("at") AS first_at, max("at") AS last_at FROM s GROUP BY course, k"""
)
def study_sessions(spark, sf):
    """Sessions of answers no more than half an hour apart, by course."""
    return practice.sessions(practice.distinct_results(read_table(spark, sf, "study_results")), ["course"])


_U = "(CAST('0x' || substring(sha256('{seed}|' || CAST(block_no AS VARCHAR)), 1, 12) AS BIGINT) + 1) / CAST(281474976710657 AS DOUBLE)"


@query(f"SELECT block_no, kind FROM (SELECT block_no, kind, round(-ln({_U.format(seed=7)}) / CASE kind WHEN 'question' THEN CAST(3 AS DOUBLE) ELSE 1 END, 9) AS draw FROM note_blocks) ORDER BY draw, block_no LIMIT 100")
def weighted_sample(spark, sf):
    """A hundred blocks, questions three times as likely as others: a sampling operator."""
    b = read_table(spark, sf, "note_blocks").select("block_no", "kind")
    return practice.weighted_sample(b, "block_no", F.when(F.col("kind") == "question", 3.0).otherwise(1.0).cast("double"), 100, seed=7).select("block_no", "kind")


@query(f"SELECT block_no, kind = 'question' AS preferred FROM note_blocks ORDER BY kind = 'question' DESC, round({_U.format(seed=11)}, 12), block_no LIMIT 30")
def mock_exam(spark, sf):
    """Thirty blocks for an exam, questions before others: a sampling operator."""
    b = read_table(spark, sf, "note_blocks").select("block_no", "kind")
    return practice.preferred_first(b, "block_no", F.col("kind") == "question", 30, seed=11).select("block_no", "preferred")


@query(
    f"""WITH r AS (SELECT block_no, course, kind, round((row_number() OVER (PARTITION BY course, kind ORDER BY {_U.format(seed=3)}, block_no) - 0.5) / CAST(count(*) OVER (PARTITION BY course, kind) AS DOUBLE), 9) AS spot FROM note_blocks)
SELECT block_no, course, kind, CAST(row_number() OVER (PARTITION BY course ORDER BY spot, kind NULLS FIRST, block_no) AS INTEGER) AS place FROM r"""
)
def interleaved_set(spark, sf):
    """Blocks of every course in an order that spreads their kinds evenly."""
    return practice.interleaved(read_table(spark, sf, "note_blocks").select("block_no", "course", "kind"), "kind", "block_no", ["course"], seed=3)


@query()
def flashcards(spark, sf):
    return notes.cards(read_table(spark, sf, "note_blocks"))


@query()
def notes_round_trip(spark, sf):
    """Fields of all blocks after their text form was parsed again."""
    text = notes.render_blocks(read_table(spark, sf, "note_blocks").where("fields IS NOT NULL")).select(F.col("block_no").cast("string").alias("file"), "text")
    return notes.parse_notes(text).select("file", "kind", "field_no", "key", "value")


@query(
    r"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, t[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(substring(line, 3), ' ') AS question, trim(substring(next_line, 3), ' ') AS answer FROM n WHERE starts_with(line, 'Q:') AND starts_with(next_line, 'A:')
"""
)
def qa_pairs(spark, sf):
    """Questions of flashcard texts with the answers in the next line."""
    from pyspark.sql import Window

    lines = read_table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    both = lines.withColumn("next_line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no")))
    hits = both.where("startswith(line, 'Q:') AND startswith(next_line, 'A:')")
    return hits.select("doc_id", "line_no", F.trim(F.substring("line", 3, 1 << 30)).alias("question"), F.trim(F.substring("next_line", 3, 1 << 30)).alias("answer"))


@query()
def markdown_digest(spark, sf):
    """Digest of the Markdown of every page."""
    return sinks.markdown_pages(read_table(spark, sf, "pages")).select("page_id", F.sha2("markdown", 256).alias("digest"))


@query()
def reading_order(spark, sf):
    """Place of every paragraph in reading order."""
    p = read_table(spark, sf, "pages")
    width = p.select("page_id", "width")
    lines = structure.paragraphs(p).select("page_id", "pos", "x0", "x1", "y0").join(width, "page_id")
    return structure.reading_order(lines, ["page_id"]).select("page_id", "pos", "place", "two_column")


@query('SELECT DISTINCT result_no, course, id, correct, "at" FROM study_results WHERE "at" IS NOT NULL AND correct IS NOT NULL AND id IS NOT NULL')
def stream_results_dedup(spark, sf):
    """Results read as a stream, lines delivered again dropped within the watermark."""
    from foliant.streaming import relearn

    return _streamed(spark, sf, lambda r: relearn.deduplicated(r).select("result_no", "course", "id", "correct", "at"), "append")


@query(f"WITH {_STATE} SELECT * FROM states WHERE course IS NOT NULL")
def stream_relearn(spark, sf):
    """State of every question, kept by a stream."""
    from foliant.streaming import relearn

    return _streamed(spark, sf, relearn.relearning_stream, "update")


def _streamed(spark: SparkSession, sf: str, make, mode: str) -> DataFrame:
    """Run a stream over the results table to its end and give what it wrote, through a folder all executors share."""
    import uuid

    from foliant.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, sf, "study_results").schema
    path = f"{sf}/study_results.parquet"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf}/study_results*.parquet")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/out")

    stream = make(source).writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
    stream.start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


from foliant import more_queries  # noqa: E402, F401  registers its queries in the tables above
