from pyspark.sql import functions as F

from foliant.llm.residue import find_residue, note_fields, signs, without_residue

GOOD = [
    "The membrane depends on the pressure.", "The ____ rises when the ____ falls.", r"\sum_{i=1}^{{n}} x_i", r"E_k = \frac{1}{2} m v^{2}", "S = { x | x > 0 }", "A server answers 404 when the requested page was not found",
    "Browsers run JavaScript in a sandbox", "A TODO list orders the steps by date", "UNSURE: TODO: write the name", "N/m", "X", "<b>flux</b> and <i>torque</i>", "Typesetters use lorem ipsum text to judge a layout before the real text exists", "", None, "  ",
]
BAD = [
    "{{ chapter }}", "${answer}", "%YEAR%", "<%= name %>", "[insert quote here]", "(page to follow)", "TODO: write the unit", "The unit is @@unit@@ and its name is @@unit@@.", "Membrane __QUOTE__", "Lorem ipsum dolor sit amet elit nisi.", "404 Not Found",
    "503 Service Unavailable. Try again in 9 seconds.", "Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Для работы сайта включите JavaScript.", "[object Object]", "undefined", '[p.N: "..."]', "xxxxxxxxxx", "Wrong: <mistake> | Right: <what the book says>",
    "Oops! Something went wrong on our end.", "asdf asdf asdf", "Traceback (most recent call last): File \"a.py\", line 2 KeyError: 'x'", "blah blah blah", "#REF!",
]


def table(spark, values):
    return spark.createDataFrame([(1, i, v, "k", "c") for i, v in enumerate(values)], "block_no long, field_no int, value string, kind string, context string")


def test_kinds_of_residue(spark):
    got = {r.field_no for r in find_residue(table(spark, [*GOOD, *BAD])).collect()}
    assert got == set(range(len(GOOD), len(GOOD) + len(BAD)))


def test_constant_marks_within_sentences_are_subjects(spark):
    shell = [f"The shell expands ${{HOME}} before command {i} runs" for i in range(5)]
    slots = [f"Our unit {name} here is shown to all" for name in ("{{unit}}", "{{term}}", "{{page}}")]
    got = {r.field_no for r in find_residue(table(spark, shell + slots)).collect()}
    assert got == {5, 6, 7}


def test_copies_of_one_unfilled_slot_are_residue(spark):
    copies = ["Dear {{name}}, welcome to the course"] * 4 + [f"Dear {{{{name}}}}, welcome to the course [p. {i}]" for i in range(3)]
    shell = [f"In case {i} the shell expands ${{HOME}} before the command" for i in "abc"] * 2
    got = {r.field_no for r in find_residue(table(spark, copies + shell)).collect()}
    assert got == set(range(7))


def test_sentences_with_exchanged_names_are_templates(spark):
    names = ["unit", "term", "page", "year"]
    marks = [m.replace("n", n) for n in names for m in ("{{n}}", "${n}")]
    filler = [f"This is some standing sentence for the {n}." for n in names]
    got = {r.field_no for r in find_residue(table(spark, marks + filler + ["This is some standing sentence for the membrane."])).collect()}
    assert got == set(range(len(marks) + len(filler)))


def test_table_cases(spark):
    schema = "block_no long, fields array<struct<key: string, value: string, line: int, raw: string>>, value string, reason int"
    rows = [(1, [("why", "{{x}}", 1, ""), ("ask", "fine", 2, "")], "v", 1), (2, None, None, None), (3, [], "", 2), (4, [(None, None, None, None), ("k", "word " * 50000 + "{{x}}", 1, "")], "v", 3)]
    blocks = spark.createDataFrame(rows, schema)
    fields = note_fields(blocks)
    got = {(r.block_no, r.field_no) for r in find_residue(fields).collect()}
    assert got == {(1, 0), (4, 1)}
    assert {(r.block_no, r.field_no) for r in without_residue(blocks, find_residue(fields)).collect()} == {(1, 1), (4, 0)}
    assert find_residue(fields.unionByName(fields)).count() == 2
    assert find_residue(fields.where(F.lit(False))).count() == 0
    assert signs(None) == []


def test_slots_are_induced_without_a_known_way_of_writing(spark):
    names = ["unit", "term", "page", "year"]
    ways = ["【请填写n】", "~~n~~", "[[bitte n eintragen]]"]
    marks = [w.replace("n】", f"{x}】").replace("~n~", f"~{x}~").replace(" n ", f" {x} ") for x in names for w in ways]
    good = ["The ~flux~ is small", "A [closed system] at rest", "T[i] < T[j] for all"]
    rows = find_residue(table(spark, marks + good)).collect()
    assert {r.field_no for r in rows} == set(range(len(marks)))
    assert {r.reason for r in rows} == {"slot"}


def test_repeated_defaults_and_pages_say_so(spark):
    values = ["test test 1", "test test 2", "test test 3", "no no", *[f"Error {n}: the server could not be found on this server." for n in (404, 410, 500)], "Access denied. Go away"]
    got = {r.field_no: r.reason for r in find_residue(table(spark, values)).collect()}
    assert got == {0: "default", 1: "default", 2: "default", 4: "page", 5: "page", 6: "page", 7: "message"}


def test_marks_quoted_by_the_citation_stand_in_the_book(spark):
    values = ['Here ${NOW} is the time [p.4: "Here ${NOW} is"]', 'Dear {{name}}, welcome [p.4: "welcome"]']
    assert {r.field_no for r in find_residue(table(spark, values)).collect()} == {1}
