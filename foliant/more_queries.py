"""Registered queries on titles, parts of books and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions import titles as ti
from foliant.operators import claims, notes, parts, structure
from foliant.queries import _FIELDS, _GARBLE, _LINES, _OUTLINE, _TOKENS, query
from foliant.session import read_table


@query(
    f"SELECT book, count(*) AS pages, CAST(sum(CAST(n >= 30 AS INTEGER)) AS BIGINT) AS with_text, CAST(sum(CAST(n < 30 AS INTEGER)) AS BIGINT) AS without_text, CAST(sum(CAST(coalesce(g > 0.01, false) AS INTEGER)) AS BIGINT) AS garbled, CAST(sum(CAST(coalesce(list_contains(flags, 'ocr'), false) AS INTEGER)) AS BIGINT) AS scans"
    rf" FROM (SELECT book, flags, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n, {_GARBLE} AS g FROM pages WHERE page_index IS NOT NULL) GROUP BY book"
)
def book_probe(spark, sf) -> DataFrame:
    """Quick look at every book, over all its pages."""
    return parts.probe(read_table(spark, sf, "pages"))


@query(
    r"""
WITH l AS (SELECT book, label, min(page_index) AS page_index FROM pages WHERE label IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL),
f AS (SELECT book, lower(label) AS low, min(page_index) AS spot FROM l GROUP BY ALL HAVING count(*) = 1),
w AS (SELECT check_id, book, string_split(regexp_replace(trim(page, ' '), '\s*[–-]\s*', '-'), '-') AS s FROM quote_checks WHERE page IS NOT NULL),
p AS (SELECT check_id, book, s[1] AS a, CASE WHEN len(s) > 1 THEN array_to_string(s[2:], '-') ELSE s[1] END AS b FROM w),
j AS (SELECT check_id, coalesce(la.page_index, fa.spot) AS first_page, coalesce(lb.page_index, fb.spot) AS last_page FROM p
  LEFT JOIN l la ON p.book = la.book AND p.a = la.label LEFT JOIN f fa ON p.book = fa.book AND lower(p.a) = fa.low LEFT JOIN l lb ON p.book = lb.book AND p.b = lb.label LEFT JOIN f fb ON p.book = fb.book AND lower(p.b) = fb.low)
SELECT check_id, first_page, last_page FROM j WHERE first_page IS NOT NULL AND last_page >= first_page AND last_page - first_page < 4
"""
)
def cited_pages(spark, sf):
    """Page indexes of the labels that quotes cite."""
    return parts.find_pages(read_table(spark, sf, "quote_checks"), read_table(spark, sf, "pages"), "check_id")


@query(
    "WITH d AS (SELECT DISTINCT book, page_index AS v FROM pages WHERE page_index IS NOT NULL), r AS (SELECT *, v - row_number() OVER (PARTITION BY book ORDER BY v) AS g FROM d), i AS (SELECT book, min(v) AS a, max(v) AS z FROM r GROUP BY book, g)"
    " SELECT book, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '-' || z END, ', ' ORDER BY a) AS ranges FROM i GROUP BY book"
)
def page_range_texts(spark, sf):
    return parts.range_texts(read_table(spark, sf, "pages"))


@query(
    f"""WITH {_OUTLINE}, once AS (SELECT book, page_index, max({_TOKENS}) AS tokens FROM pages WHERE text IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL),
sized AS (SELECT DISTINCT s.book, section, o.page_index, tokens FROM sections s JOIN once o ON s.book = o.book AND o.page_index BETWEEN first_page AND last_page),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY book, section ORDER BY page_index) - tokens AS before, sum(tokens) OVER (PARTITION BY book, section) AS total FROM sized)
SELECT book, section, CAST(floor(before / (total / greatest(ceil(total / CAST(1500 AS DOUBLE)), CAST(1 AS DOUBLE)))) AS INTEGER) AS part, min(page_index) AS first_page, max(page_index) AS last_page, CAST(sum(tokens) AS BIGINT) AS tokens FROM w GROUP BY ALL"""
)
def section_parts(spark, sf):
    """Sections cut into parts of about 1,500 tokens."""
    p = read_table(spark, sf, "pages")
    inside = structure.section_pages(p, structure.outline(p))
    return parts.section_parts(inside, p)


@query(
    "WITH e AS (SELECT book, max(page_index) AS last FROM pages WHERE book IS NOT NULL GROUP BY book), s AS (SELECT book, last, unnest(range(0, last + 1, 6)) AS a FROM e WHERE last IS NOT NULL)"
    " SELECT book, CAST(a / 6 + 1 AS INTEGER) AS part, CAST(a AS INTEGER) AS first_page, CAST(least(a + 5, last) AS INTEGER) AS last_page FROM s"
)
def fallback_sections(spark, sf):
    return parts.fallback_sections(read_table(spark, sf, "pages"))


@query("SELECT block_no, id, CASE WHEN r = 1 THEN id ELSE id || '-' || r END AS unique_id FROM (SELECT block_no, id, row_number() OVER (PARTITION BY course, id ORDER BY block_no) AS r FROM note_blocks WHERE id IS NOT NULL)")
def unique_block_ids(spark, sf):
    """Ids of blocks made unique in each course."""
    b = read_table(spark, sf, "note_blocks").where("id IS NOT NULL").select("block_no", "course", "id")
    return parts.unique_ids(b, ["course"], "id", [F.col("block_no")]).select("block_no", "id", "unique_id")


@query()
def exam_questions(spark, sf):
    """Numbered questions of exam papers."""
    return parts.split_questions(read_table(spark, sf, "documents").where("kind = 'exam paper'").select("doc_id", "text"), "doc_id")


@query(
    "WITH l AS (SELECT book, page_index, arg_max(text, page_id) AS text, arg_max(label, page_id) AS label FROM pages WHERE page_index IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"
    " SELECT book, page_index, sha256('PAGE ' || coalesce(label, CAST(page_index AS VARCHAR)) || chr(10) || text) AS digest FROM l"
)
def source_texts(spark, sf):
    """Digest of every page as it stands in a book's source text."""
    return parts.source_text(read_table(spark, sf, "pages")).select("book", "page_index", F.sha2("part", 256).alias("digest"))


@query(
    rf"""WITH {_LINES}, n AS (SELECT book, page_index, page_id, line_no, CAST(regexp_extract(line, '^([0-9]+)\.', 1) AS INTEGER) AS chapter, CAST(regexp_extract(line, '^[0-9]+\.([0-9]+)', 1) AS INTEGER) AS section FROM lines
  WHERE page_index IS NOT NULL AND regexp_matches(line, '^[0-9]{{1,2}}\.[0-9]{{1,2}} +\p{{Lu}}')),
b AS (SELECT *, lag(chapter) OVER w AS pc, lag(section) OVER w AS ps FROM n WINDOW w AS (PARTITION BY book ORDER BY page_index, page_id, line_no))
SELECT book, count(*) AS headings, CAST(sum(CAST(coalesce((pc = chapter AND ps + 1 = section) OR (pc + 1 = chapter AND section <= 1), true) AS INTEGER)) AS BIGINT) AS in_order FROM b GROUP BY book"""
)
def heading_order(spark, sf):
    """How many numbered headings follow the one before."""
    h = parts.numbered_headings(read_table(spark, sf, "pages"))
    return h.groupBy("book").agg(F.count("*").alias("headings"), F.sum(F.col("follows").cast("int")).cast("long").alias("in_order"))


@query()
def title_numbers(spark, sf):
    """Chapter numbers and bare titles of all lines that have them."""
    p = read_table(spark, sf, "pages").where("text IS NOT NULL").select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return p.select("page_id", "line_no", ti.chapter_number(F.col("line")).alias("chapter"), ti.without_number(F.col("line")).alias("title"), ti.is_introduction(F.col("line")).alias("introduction")).where("chapter IS NOT NULL")


_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace({v}, '\[p\.?\s*[^\]]*\]', ' ', 'g'), '\(covers:\s*([^)]*)\)', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_CLAIMS = rf"""{_FIELDS}, s AS (SELECT block_no, field_no, key, {_BARE.format(v="value")} AS claim, regexp_extract_all(value, '\[p\.?\s*([^:\]"]+):\s*"([^"]*)"\s*\]', 2) AS quotes FROM f
  WHERE key IN ({", ".join(repr(k) for k in claims.CLAIM_KEYS)}) AND value IS NOT NULL AND NOT starts_with(upper(trim(value, ' ')), 'UNSURE')),
k AS (SELECT *, regexp_replace(lower(claim), '[^\p{{L}}\p{{N}}]', '', 'g') AS ck, regexp_replace(lower(quotes[1]), '[^\p{{L}}\p{{N}}]', '', 'g') AS qk FROM s WHERE claim != ''),
c AS (SELECT 'C' || substring(sha256(concat_ws('|', block_no || '#' || key || '#' || field_no, claim, array_to_string(quotes, '|'))), 1, 10) AS claim_id, block_no, field_no, key, claim, quotes, coalesce(length(ck) >= 20 AND contains(qk, ck) AND length(ck) >= length(qk) * CAST(0.9 AS DOUBLE), false) AS verbatim FROM k)"""


@query(f"WITH {_CLAIMS} SELECT claim_id, block_no, CAST(field_no AS INTEGER) AS field_no, key, verbatim FROM c")
def note_claims(spark, sf):
    """Claims of all notes and whether they only repeat their quote."""
    return claims.claims(read_table(spark, sf, "note_blocks")).select("claim_id", "block_no", "field_no", "key", "verbatim")


_ISSUES = rf"""{_CLAIMS},
units AS (SELECT claim_id, list_distinct(list_concat(regexp_extract_all(regexp_replace(lower(claim), '\p{{Han}}', ' ', 'g'), '\p{{L}}{{3,}}|[0-9]+(?:[.,][0-9]+)*'),
  list_filter(list_transform(range(1, length(claim)), lambda i: substring(claim, i, 2)), lambda x: regexp_full_match(x, '\p{{Han}}{{2}}')))) AS us FROM c WHERE key = 'why'),
quoted AS (SELECT claim_id, q, length(regexp_replace(lower(q), '[^\p{{L}}\p{{N}}]', '', 'g')) AS n FROM (SELECT claim_id, unnest(quotes) AS q FROM c)),
issues AS (SELECT claim_id, 'no-citation' AS code FROM c WHERE len(quotes) = 0
  UNION ALL SELECT DISTINCT claim_id, 'quote-short' FROM quoted WHERE NOT ((len(regexp_extract_all(q, '\S+')) >= 4 AND n >= 12) OR (len(regexp_extract_all(q, '{tx.CJK}')) * 2 > n AND n >= 8))
  UNION ALL SELECT claim_id, 'says-nothing' FROM units WHERE len(list_filter(us, lambda u: u NOT IN ({", ".join(repr(w) for w in ti.META_WORDS)}))) < 2)"""


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def claim_issues(spark, sf):
    return claims.claim_issues(claims.claims(read_table(spark, sf, "note_blocks")))


@query(
    f"""WITH {_ISSUES}, st AS (SELECT c.block_no, CASE WHEN i.claim_id IS NOT NULL THEN 2 WHEN verbatim THEN 0 ELSE 1 END AS r FROM c LEFT JOIN (SELECT DISTINCT claim_id FROM issues) i ON c.claim_id = i.claim_id)
SELECT block_no, CASE max(r) WHEN 2 THEN 'warn' WHEN 1 THEN 'pending' ELSE 'ok' END AS status, count(*) AS claims FROM st GROUP BY block_no"""
)
def block_trust(spark, sf):
    """Status of every block: the worst of its claims."""
    c = claims.claims(read_table(spark, sf, "note_blocks"))
    return claims.block_trust(c, claims.claim_issues(c))


@query(f"WITH {_CLAIMS}, g AS (SELECT key, count(*) AS claims, CAST(sum(CAST(verbatim AS INTEGER)) AS BIGINT) AS verbatim, CAST(sum(CAST(len(quotes) = 0 AS INTEGER)) AS BIGINT) AS uncited FROM c GROUP BY key) SELECT *, round(verbatim / CAST(claims AS DOUBLE), 6) AS verbatim_share, round(uncited / CAST(claims AS DOUBLE), 6) AS uncited_share FROM g")
def evidence_metrics(spark, sf):
    """Shares of claims that repeat their quote and that have none, by field."""
    c = claims.claims(read_table(spark, sf, "note_blocks"))
    counts = c.groupBy("key").agg(F.count("*").alias("claims"), F.sum(F.col("verbatim").cast("int")).cast("long").alias("verbatim"), F.sum((F.size("quotes") == 0).cast("int")).cast("long").alias("uncited"))
    return claims.ratios(counts, ["verbatim", "uncited"], "claims")


@query(
    rf"WITH {_FIELDS}, x AS (SELECT block_no, field_no, value AS v FROM f WHERE key = 'latex' AND value IS NOT NULL) SELECT block_no, CAST(field_no AS INTEGER) AS field_no, CASE WHEN regexp_matches(v, '\s\+\s') THEN regexp_replace(v, '^(.*?)\s\+\s', '\1 - ') WHEN regexp_matches(v, '[^\s=] - ') THEN regexp_replace(v, '^(.*?[^\s=]) - ', '\1 + ')"
    r" WHEN regexp_matches(v, '\\frac\{[^{}]*\}\{[^{}]*\}') THEN regexp_replace(v, '^(.*?)\\frac\{([^{}]*)\}\{([^{}]*)\}', '\1\\frac{\3}{\2}') WHEN regexp_matches(v, '\^\{?2\}?') THEN regexp_replace(v, '^(.*?)\^\{?2\}?', '\1^{3}') WHEN contains(v, '=') THEN regexp_replace(v, '^(.*?)=\s*', '\1= 2 ') END AS mutated FROM x"
)
def mutate_formulas(spark, sf):
    """Formulas of notes made false."""
    f = notes.fields(read_table(spark, sf, "note_blocks")).where("key = 'latex' AND value IS NOT NULL")
    return f.select("block_no", "field_no", ti.wrong_formula(F.col("value")).alias("mutated"))


@query(
    rf"WITH {_FIELDS}, t AS (SELECT block_no, arg_min(value, field_no) AS term FROM f WHERE key = 'term' AND value IS NOT NULL GROUP BY block_no), d AS (SELECT block_no, arg_min(value, field_no) AS definition FROM f WHERE key = 'definition' AND value IS NOT NULL GROUP BY block_no)"
    rf" SELECT upper(substring({_BARE.format(v='term')}, 1, 1)) AS letter, count(*) AS terms, count(DISTINCT {_BARE.format(v='term')}) AS distinct_terms FROM t JOIN d ON t.block_no = d.block_no WHERE {_BARE.format(v='term')} != '' GROUP BY ALL"
)
def lookup_letters(spark, sf):
    """Terms with definitions by first letter, as in a look-up list."""
    f = notes.fields(read_table(spark, sf, "note_blocks")).where("value IS NOT NULL")
    term = f.where("key = 'term'").groupBy("block_no").agg(F.min_by("value", "field_no").alias("term"))
    defined = f.where("key = 'definition'").select("block_no").distinct()
    bare = tx.strip_citations(F.col("term"))
    return term.join(defined, "block_no").withColumn("t", bare).where("t != ''").groupBy(F.upper(F.substring("t", 1, 1)).alias("letter")).agg(F.count("*").alias("terms"), F.count_distinct("t").alias("distinct_terms"))


@query("WITH d AS (SELECT DISTINCT ON (result_no) result_no, course, id, correct FROM study_results WHERE \"at\" IS NOT NULL AND correct IS NOT NULL AND id IS NOT NULL) SELECT course, id, count(*) AS answers, CAST(sum(CAST(NOT correct AS INTEGER)) AS BIGINT) AS missed FROM d GROUP BY course, id HAVING sum(CAST(NOT correct AS INTEGER)) >= 2")
def missed_questions(spark, sf):
    """Questions missed at least twice."""
    from foliant.operators import practice

    r = practice.distinct_results(read_table(spark, sf, "study_results"))
    return r.groupBy("course", "id").agg(F.count("*").alias("answers"), F.sum((~F.col("correct")).cast("int")).cast("long").alias("missed")).where("missed >= 2")


@query(f"WITH {_OUTLINE}, b AS (SELECT book, page_index, max(CAST(list_has_any(coalesce(flags, []), ['garbled', 'scanned-no-text', 'blank', 'extraction-error', 'ocr']) AS INTEGER)) AS bad FROM pages GROUP BY ALL) SELECT s.book, section, count(*) AS pages, CAST(sum(bad) AS BIGINT) AS doubtful FROM sections s JOIN b ON s.book = b.book AND b.page_index BETWEEN first_page AND last_page GROUP BY ALL")
def doubtful_pages(spark, sf):
    """Pages of every section and how many of them a flag makes doubtful."""
    p = read_table(spark, sf, "pages")
    bad = F.coalesce(F.arrays_overlap("flags", F.array(*[F.lit(x) for x in ("garbled", "scanned-no-text", "blank", "extraction-error", "ocr")])), F.lit(False))
    once = p.groupBy("book", "page_index").agg(F.max(bad.cast("int")).alias("bad"))
    inside = structure.section_pages(p, structure.outline(p)).select("book", "section", "page_index").distinct()
    return inside.join(once, ["book", "page_index"]).groupBy("book", "section").agg(F.count("*").alias("pages"), F.sum("bad").cast("long").alias("doubtful"))


from foliant.operators import inventory  # noqa: E402
from foliant.queries import _FIRSTS, _PARAS, ORACLES  # noqa: E402

_BODY = f"""{_PARAS}, bs AS (SELECT book, p.size AS size, sum(length(p.text)) AS chars FROM paras_ WHERE p.size IS NOT NULL AND p.text IS NOT NULL GROUP BY ALL),
bb AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chars DESC, size) AS r, sum(chars) OVER (PARTITION BY book) AS all_chars FROM bs), body AS (SELECT book, size AS body_size FROM bb WHERE r = 1 AND all_chars > 2000)"""
ORACLES["foot_notes"] = rf"""WITH {_BODY}, n AS (SELECT page_id, pos, p.y0 AS y0, coalesce(p.size < body_size * CAST(0.9 AS DOUBLE), false) OR coalesce(regexp_matches(p.text, '^\s*(?:\[[0-9]{{1,2}}\]|[*†‡])'), false) AS hit
  FROM paras_ LEFT JOIN body ON paras_.book = body.book WHERE p.y0 >= height * CAST(0.7 AS DOUBLE)),
w AS (SELECT *, bool_or(hit) OVER (PARTITION BY page_id ORDER BY y0, pos ROWS UNBOUNDED PRECEDING) AS note FROM n) SELECT page_id, CAST(pos AS INTEGER) AS pos FROM w WHERE note"""
ORACLES["confusable_terms"] = (
    f"WITH {_FIRSTS}, tt AS (SELECT book, term, string_split(term, ' ')[-1] AS last, string_split(term, ' ')[1] AS first FROM firsts), u AS (SELECT * FROM tt WHERE term != last),"
    " p AS (SELECT a.book, a.term AS term_a, b.term AS term_b, CASE WHEN "
    + " OR ".join(f"(a.first = '{x}' AND b.first = '{y}') OR (a.first = '{y}' AND b.first = '{x}')" for x, y in inventory.OPPOSITES)
    + " THEN 1 ELSE 2 END AS reason FROM u a JOIN u b ON a.book = b.book AND a.last = b.last AND a.term < b.term),"
    " r AS (SELECT *, CAST(row_number() OVER (PARTITION BY book ORDER BY reason, term_a, term_b) AS INTEGER) AS rank FROM p) SELECT book, term_a, term_b, CAST(reason AS INTEGER) AS reason, rank FROM r WHERE rank <= 5"
)
ORACLES["joined_line_ends"] = rf"""WITH {_LINES}, n AS (SELECT page_id, line_no, lower(line) AS line, lower(lead(line) OVER (PARTITION BY page_id ORDER BY line_no)) AS nxt FROM lines),
e AS (SELECT page_id, line_no, regexp_extract(line, '([\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*)-\s*$', 1) AS tail, regexp_extract(nxt, '^\s*([\p{{Ll}}\p{{N}}]+)', 1) AS head FROM n WHERE nxt IS NOT NULL),
v AS (SELECT unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*')) AS word FROM lines), k AS (SELECT word, count(*) AS n FROM v GROUP BY word)
SELECT page_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN coalesce(c.n, 0) > coalesce(w.n, 0) THEN tail || '-' || head ELSE tail || head END AS word FROM e LEFT JOIN k w ON w.word = tail || head LEFT JOIN k c ON c.word = tail || '-' || head WHERE tail != '' AND head != ''"""
ORACLES["flashcards"] = (
    f"WITH {_FIELDS}, g AS (SELECT block_no, kind, arg_min(value, field_no) FILTER (key = 'term') AS term, arg_min(value, field_no) FILTER (key = 'definition') AS definition, arg_min(value, field_no) FILTER (key = 'ask') AS ask, arg_min(value, field_no) FILTER (key = 'answer') AS answer FROM f WHERE value IS NOT NULL GROUP BY ALL),"
    " c AS (SELECT block_no, term AS a, definition AS b FROM g WHERE kind = 'concept' UNION ALL SELECT block_no, ask, answer FROM g WHERE kind = 'question'),"
    f" d AS (SELECT block_no, {_BARE.format(v='a')} AS front, {_BARE.format(v='b')} AS back FROM c) SELECT * FROM d WHERE front != '' AND back != ''"
)
ORACLES["reading_order"] = f"""WITH {_PARAS}, l AS (SELECT paras_.page_id, pos, p.x0 AS x0, p.x1 AS x1, p.y0 AS y0, pages.width AS width FROM paras_ JOIN pages ON paras_.page_id = pages.page_id),
s AS (SELECT *, CASE WHEN x1 <= width / 2 * CAST(1.04 AS DOUBLE) THEN 1 WHEN x0 >= width / 2 * CAST(0.96 AS DOUBLE) THEN 2 ELSE 0 END AS side FROM l),
t AS (SELECT *, sum(CAST(side = 1 AS INTEGER)) OVER w >= 8 AND sum(CAST(side = 2 AS INTEGER)) OVER w >= 8 AND sum(CAST(side = 0 AS INTEGER)) OVER w < count(*) OVER w * CAST(0.25 AS DOUBLE) AS two FROM s WINDOW w AS (PARTITION BY page_id)),
u AS (SELECT *, CASE WHEN two THEN side ELSE 0 END AS sd FROM t), b AS (SELECT *, CASE WHEN two THEN sum(CAST(sd = 0 AS INTEGER)) OVER (PARTITION BY page_id ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) ELSE 0 END AS band FROM u)
SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, sd, y0, x0) AS INTEGER) AS place, two AS two_column FROM b"""
ORACLES["page_quality_flags"] = rf"""WITH q AS (SELECT page_id, width, height, images, two_column, coalesce(text, '') AS text FROM pages),
m AS (SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS chars, coalesce(coalesce(list_sum(list_transform(images, lambda r: (r[3] - r[1]) * (r[4] - r[2]))), 0) > width * height * CAST(0.45 AS DOUBLE), false) AS covered, {_GARBLE} AS garble,
  len(list_filter(string_split(text, chr(10)), lambda x: (contains(x, '=') AND length(x) < 90) OR len(regexp_extract_all(x, '[=+×÷∑∫√≈≠≤≥∞±^]')) >= 3 OR regexp_matches(x, '\(\d+\.\d+\)\s*$'))) AS formulas, len(regexp_extract_all(text, '[_^](?:\{{[^}}]*\}}|[\p{{L}}\p{{N}}_])')) AS scripts FROM q)
SELECT page_id, array_to_string(list_filter([CASE WHEN chars < 30 AND covered THEN 'scanned-no-text' END, CASE WHEN chars < 30 AND NOT covered THEN 'blank' END, CASE WHEN garble > 0.01 THEN 'garbled' END,
  CASE WHEN formulas >= 3 OR scripts >= 6 THEN 'math-heavy' END, CASE WHEN coalesce(two_column, false) THEN 'two-column' END], lambda x: x IS NOT NULL), ',') AS flags FROM m"""


from foliant.operators import lint  # noqa: E402


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_OFF_LIST = " OR ".join(f"(key = '{key}' AND lower(v) NOT IN ({_listed(values)}))" for key, values in lint.ALLOWED.items())


@query(
    rf"""WITH {_FIELDS}, g AS (SELECT block_no, field_no, key, trim(value, ' ') AS v, starts_with(upper(trim(value, ' ')), 'UNSURE') AS unsure FROM f WHERE value IS NOT NULL AND trim(value, ' ') != ''),
i AS (SELECT block_no, field_no, 'unsure-not-allowed' AS code FROM g WHERE unsure AND key IN ({_listed(lint.DEFINITE)})
  UNION ALL SELECT block_no, field_no, 'unsure-reason' FROM g WHERE unsure AND key NOT IN ({_listed(lint.DEFINITE)}) AND len(regexp_extract_all(regexp_replace(v, '^[Uu][Nn][Ss][Uu][Rr][Ee][\s:]*', ''), '\S+')) < {lint.REASON_WORDS}
  UNION ALL SELECT block_no, field_no, 'bad-value' FROM g WHERE NOT unsure AND ({_OFF_LIST})
  UNION ALL SELECT block_no, field_no, 'no-citation' FROM g WHERE NOT unsure AND key IN ({_listed(lint.RESTING)}) AND NOT regexp_matches(v, '\[p\.?\s*[^\]]+\]')
  UNION ALL SELECT block_no, field_no, 'bad-id' FROM g WHERE NOT unsure AND key = 'covers' AND len([x FOR x IN string_split(v, ',') IF NOT regexp_matches(trim(x, ' '), '^[A-Z]{{1,4}}-[\w.-]+$')]) > 0
  UNION ALL SELECT block_no, field_no, 'no-pair' FROM g WHERE NOT unsure AND key = 'misconception' AND NOT regexp_matches(v, '(?is)^wrong:.*\|\s*right:'))
SELECT block_no, CAST(field_no AS INTEGER) AS field_no, code FROM i"""
)
def lint_fields(spark, sf):
    """What is wrong with single fields of note blocks."""
    return lint.field_issues(read_table(spark, sf, "note_blocks"))


_QUOTE = f"regexp_extract_all(definition, '{tx.CITATION}', 2)[1]"
_KEY_OF = "regexp_replace(lower({v}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(
    rf"""WITH {_FIELDS}, g AS (SELECT block_no, kind, field_no, key, trim(value, ' ') AS v FROM f WHERE value IS NOT NULL AND trim(value, ' ') != ''),
q AS (SELECT block_no, arg_min(v, field_no) FILTER (key = 'type') AS type, list({_KEY_OF.format(v="v")}) FILTER (regexp_full_match(key, 'option [a-d]')) AS choices FROM g WHERE kind = 'question' GROUP BY block_no),
k AS (SELECT block_no, arg_min(v, field_no) FILTER (key = 'plain') AS plain, arg_min(v, field_no) FILTER (key = 'definition') AS definition FROM g WHERE kind = 'concept' GROUP BY block_no),
s AS (SELECT block_no, {_KEY_OF.format(v=_BARE.format(v="plain"))} AS said, {_KEY_OF.format(v=_QUOTE)} AS quote FROM k)
SELECT block_no, 'few-choices' AS code FROM q WHERE lower(type) = 'mcq' AND coalesce(len(choices), 0) < {lint.LEAST_CHOICES}
UNION ALL SELECT block_no, 'same-choices' FROM q WHERE lower(type) = 'mcq' AND len(list_distinct(choices)) < len(choices)
UNION ALL SELECT block_no, 'plain-copies-definition' FROM s WHERE said != '' AND quote != '' AND length(said) >= length(quote) * CAST({lint.COPY_SHARE} AS DOUBLE) AND round(1 - levenshtein(said, quote) / CAST(greatest(length(said), length(quote)) AS DOUBLE), 9) >= {lint.COPY_LIKENESS}"""
)
def lint_blocks(spark, sf):
    """What is wrong between the fields of note blocks."""
    return lint.block_issues(read_table(spark, sf, "note_blocks"))


@query(
    rf"""WITH {_FIELDS}, c AS (SELECT DISTINCT block_no, trim(id, ' ') AS id FROM (SELECT block_no, unnest(string_split(value, ',')) AS id FROM f WHERE key = 'covers' AND value IS NOT NULL)),
w AS (SELECT c.block_no, c.id, course FROM c JOIN note_blocks b ON c.block_no = b.block_no WHERE course IS NOT NULL AND regexp_matches(c.id, '^[A-Z]{{1,4}}-[\w.-]+$'))
SELECT DISTINCT block_no, id FROM w WHERE NOT EXISTS (SELECT 1 FROM note_blocks n WHERE n.course = w.course AND n.id = w.id)"""
)
def dead_links(spark, sf):
    """Covered ids that no block of the course has."""
    return lint.dead_links(read_table(spark, sf, "note_blocks"))
