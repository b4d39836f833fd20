import random
import re
from datetime import date

from pyspark.sql import functions as F

from docmarket.operators import quality as Q, structure as C, temporal as D
from docmarket.plans.analysis import score_documents

RESUME = """Ana Example
ana@example.org +1 5551234567
https://github.com/ana https://linkedin.com/in/ana
Experience
Engineer at Acme Jan 2020 - Jun 2020
- Built an api, reduced cost 20%
Analyst at Beta Mar 2020 - Dec 2020
Projects: Prototype Jan 2022 - Apr 2022
- Designed dashboard for 40 users
SKILLS | python, sql EDUCATION | University of X
"""
HEADERS = C.Headers()


def docs(spark, text=RESUME):
    return spark.createDataFrame([("d", text, "application/pdf")], "doc_id string, text string, content_type string")


def test_sections(spark):
    got = {r["section"]: r["text"] for r in C.assign_sections(docs(spark), "doc_id", "text", HEADERS).collect()}
    assert set(got) == {"summary", "experience", "projects", "skills", "education"}
    assert got["experience"].startswith("Engineer at Acme") and "Beta" in got["experience"]
    assert got["projects"].startswith("Prototype") and got["skills"] == "| python, sql" and got["education"] == "| University of X"


def test_inline_header_rules(spark):
    lines = spark.createDataFrame([(1, "Experience with tools"), (2, "we value skills and projects"), (3, "Skills: a | Projects: b"), (4, "x EDUCATION y")], "n int, line string")
    got = {r["n"]: [] for r in lines.collect()}
    for r in C.split_inline_headers(lines, HEADERS, ["n"]).orderBy("n", "pos").collect():
        got[r["n"]].append((r["section"], r["content"]))
    assert got == {1: [], 2: [], 3: [("skills", "a |"), ("projects", "b")], 4: [("education", "y")]}


def test_strict_headers(spark):
    lines = spark.createDataFrame([("Experience with X",), ("Experience: X",)], "line string")
    assert C.detect_headers(lines, C.Headers(strict=True), []).count() == 1
    assert C.detect_headers(lines, HEADERS, []).count() == 2


def test_experience_worked_example(spark):
    # Jan-Jun and Mar-Dec 2020 merge to 12 months; the project adds 4 * 0.55; 14.2 / 12 = 1.18
    sections = C.assign_sections(docs(spark), "doc_id", "text", HEADERS)
    got = D.experience_years(sections, "doc_id", F.lit(date(2024, 5, 17))).first()
    assert got["experience_years"] == 1.18


def test_merge_intervals(spark):
    rows = [("a", date(2020, 1, 1), date(2020, 3, 1)), ("a", date(2020, 3, 1), date(2020, 4, 1)), ("a", date(2020, 2, 1), date(2020, 2, 1)), ("a", date(2020, 5, 1), date(2020, 6, 1))]
    df = spark.createDataFrame(rows + rows[:2], "k string, s date, e date")
    once = D.merge_intervals(df, ["k"], "s", "e")
    want = {(date(2020, 1, 1), date(2020, 4, 1)), (date(2020, 5, 1), date(2020, 6, 1))}
    assert {(r["s"], r["e"]) for r in once.collect()} == want
    assert {(r["s"], r["e"]) for r in D.merge_intervals(once, ["k"], "s", "e").collect()} == want


def test_repetition(spark):
    long = "Built the reporting platform for all of sales"
    text = "\n".join([long] * 3 + ["Built a", "Built b", "other"])
    got = spark.createDataFrame([(text,)], "t string").select(Q.repetition_penalty(F.col("t"))).first()[0]
    assert got == 5.0  # two repeats at 1.5, and one verb opens all action lines


def test_scores_are_bounded(spark):
    both = docs(spark).unionByName(docs(spark, "nothing here"))
    for r in score_documents(both, "doc_id", "text", HEADERS, F.lit(date(2024, 5, 17))).collect():
        assert 18 <= r["resume_quality"] <= 96 and 14 <= r["ats_compliance"] <= 95 and 18 <= r["parser_confidence"]["score"] <= 98


def plain_inline(line, headers):
    """The rule of inline headers, place by place."""
    taken = []
    for alias in sorted(headers.section, key=len, reverse=True):
        for hit in re.finditer(rf"(?<![A-Za-z]){re.escape(alias)}(?![A-Za-z])", line, re.I | re.A):
            start, end = hit.span()
            letters = [ch for ch in hit[0] if ch.isalpha()]
            beside = re.search(r"[:|•-]\s*$", line[max(0, start - 3) : start]) or re.match(r"\s*[:|-]", line[end : end + 2])
            if start and not beside and sum(map(str.isupper, letters)) < 0.8 * len(letters):
                continue
            if all(start >= e or end <= s for s, e, _ in taken):
                taken.append((start, end, headers.section[alias]))
    taken.sort()
    if len(taken) == 1 and taken[0][0] == 0:
        return []
    stops = [s for s, _, _ in taken[1:]] + [len(line)]
    return [(section, line[end:stop].strip(" :-")) for (_, end, section), stop in zip(taken, stops)]


def test_inline_headers_equal_the_plain_rule(spark):
    headers = C.Headers({"a": ("work", "work done", "done in"), "b": ("in school", "school"), "c": ("key skills", "skills")})
    pieces = ["work", "WORK", "Work", "done", "DONE", "in", "IN", "school", "SCHooL", "key", "skills", "SKILLS", ":", "|", "-", "•", "é", "x", "  "]
    draw = random.Random(5)
    lines = [draw.choice(["", " "]).join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(3000)]
    lines = [line.strip() for line in lines if line.strip()] + [" ".join(["SKILLS: x"] * 500), "work done in school - work DONE IN SCHOOL"]
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {}
    for r in C.split_inline_headers(rows, headers, ["n"]).orderBy("n", "pos").collect():
        got.setdefault(r["n"], []).append((r["section"], r["content"]))
    want = {n: found for n, line in enumerate(lines) if (found := plain_inline(line, headers))}
    assert got == want
    assert len(want) > 500


def test_headers_are_searched_once(spark):
    text = "\n".join([RESUME, "SKILLS | a PROJECTS | b", "Education & Skills", "  Summary :  x  y"])
    twice = spark.createDataFrame([("d", text, "a"), ("e", "", "a"), ("f", None, "a"), ("g", "Experience", "a")], "doc_id string, text string, content_type string")
    out = C.parse_signals(twice, "doc_id", "text", HEADERS)
    scored = score_documents(twice, "doc_id", "text", HEADERS, F.lit(date(2024, 5, 17)))
    for df in (out, scored):
        assert "(?<![A-Za-z])" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in out.collect()}
    lines = C.explode_lines(twice, "doc_id", "text")
    for r in C.header_signals(lines, "doc_id", HEADERS).collect():
        assert {n: got[r["doc_id"]][n] for n in r.asDict()} == r.asDict()
    assert len(got) == 4 and got["d"]["explicit_header_count"] >= 4 and got["e"]["explicit_header_count"] == 0


def test_marked_lines_and_merged_headers_by_pattern(spark):
    """The looks that pass a line by agree with the whole search."""
    import random

    from docmarket.functions import text as T
    from docmarket.operators import structure as C

    rng = random.Random(3)
    pieces = ["the", "of the", "THE", "OF ThE", "skills", "Skills", "r&d", "R&D", "R&", ":", " :", "|", "•", "- ", " ", "  ", "&", " ", "x", "ab", "Tools", "tools", "TOOLs", "é", "K", "the:"]
    lines = sorted({"".join(rng.choice(pieces) + rng.choice(("", " ")) for _ in range(rng.randrange(1, 7))) for _ in range(4000)} | {"the", "", "the&skills", "the skills", "x the y skills"})
    headers = C.Headers({"a": ("the", "of the"), "b": ("skills", "r&d"), "c": ("tools",)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, line string")
    whole = C.Headers(headers_of(headers))
    whole._marked, whole._first_token = "", ""
    line = C.F.col("line")
    low = C.F.regexp_replace(C.F.lower(line), "^:+|:+$", "")
    tokens = C.F.split(C.F.replace(low, C.F.lit("&"), C.F.lit(" ")), T.SPACE + "+")
    many = C.F.size(C.F.filter(tokens, lambda t: t.isin(*headers.section))) >= 2
    same = df.select(
        "line", headers.inline(line).eqNullSafe(whole.inline(line)).alias("i"), headers.detect(line).eqNullSafe(whole.detect(line)).alias("d"), (low.rlike(headers._two_tokens) == many).alias("m"),
        C.F.size(whole.inline(line)).alias("n"), many.alias("many"),
    )
    assert same.filter("NOT (i AND d AND m)").collect() == []
    assert same.filter("n > 0").count() > 100 and same.filter("many").count() > 100
    # Prose that has no sign beside an alias and no capitals is passed by.
    prose = spark.createDataFrame([("This is the prose of the house - well, The skills",), ("and of the tools",)], "line string")
    assert prose.filter(line.rlike(headers._marked)).count() == 0


def headers_of(headers):
    sections = {}
    for alias, name in headers.section.items():
        sections.setdefault(name, []).append(alias)
    return sections
