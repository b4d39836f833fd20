"""Long texts are cleaned once, however many scores search them."""

import random
import re

from pyspark.sql import functions as F

from docmarket.catalog import alignment as A
from docmarket.functions import text as T
from docmarket.operators import alignment as G


def test_candidate_texts_are_cleaned_once(spark):
    scored = A.annotated(spark, "/root/testdata/sf0.001")
    scored = scored.withColumns(G.context_signals({n: F.col(n) for n in ("desc_words", "all_words")}))
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    plan = scored.select("title_alignment", "role_fit", "core_text", "specialty_overlap", "n_words", "low_signal", "market_hits", "primary_hits")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    # The words of the description, and what role_fit reads with its blanks as they are.
    assert len(re.findall(r"regexp_replace\(lower\([^)]*description", plan)) == 2
    assert not re.findall(r"concat_ws\( , [^)]*description", plan)


def test_listed_characters_match_as_ranges_do(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aZbQ09+# .,-_éßİK\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    c = F.col("t")
    camel = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    pairs = {
        "words": (T.clean_words(c), F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9+]+", " "))),
        "label": (T.clean_label(c), F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, camel, " ")), r"[^a-z0-9+]+", " "))),
        "any": (T.contains_any(c, ("a+", "9 .", "é", "ZZ")), c.rlike(r"a\+|9 \.|é|ZZ")),
        "joined": (T.join_clean(T.clean_words(c), T.clean_words(F.reverse(c))), T.clean_words(F.concat_ws(" ", c, F.reverse(c)))),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[x.eqNullSafe(y).alias(n) for n, (x, y) in pairs.items()])
    assert rows.filter(" AND ".join(f"`{n}`" for n in pairs)).count() == 400


def test_a_look_at_the_next_character_changes_no_match(spark):
    from docmarket.operators import quality as Q, structure as C

    rng = random.Random(6)
    words = ("objective", "ſkills", "Kpi", "i", "ME", "40%", "12 days", "٣", "9k", "a@b.co", "+91 98765 43210 12", "-12345678901", "Jan 2020 - now", "2019-2021", "\x85", " ", "\n", "\t", "led", "Taught", "p&l", "  ", "é")
    texts = ["".join(rng.choice(words) + rng.choice((" ", "", ", ")) for _ in range(rng.randrange(12))) for _ in range(500)]
    c = F.col("t")
    count = lambda p: F.regexp_count(c, F.lit(p))
    contact = T.extract_contact(c)
    date = C.DATE_RANGE.replace("(?=[0123456789jfmasond])", "")
    assert date != C.DATE_RANGE and T.after_first(r"\b(ab|cd)\b") == r"(?=[ac])\b(ab|cd)\b" and T.after_first(r"\b(a?b)\b") == r"\b(a?b)\b"
    pairs = {name: (marks, count("(?iU)" + T.MARKERS[name])) for name, marks in T.count_markers(c).items()}
    pairs |= {
        "email": (contact["email"], F.regexp_extract(c, T.EMAIL, 0)), "phone": (contact["phone"], F.regexp_extract(c, T.PHONE, 0)), "dates": (count(C.DATE_RANGE), count(date)),
        "numbers": (Q.text_evidence(c)["number_hits"], count(r"(?U)\b\d+%|\b\d+[kKmM]?\b")), "impact": (Q.text_evidence(c)["impact_hits"], count(Q.IMPACT)),
        "quantified": (c.rlike(C.QUANTIFIED), c.rlike(r"(?U)\b\d[\d,]*\b|%")), "lines": (F.split(c, C.LINE_BREAK), F.split(c, C.LINE_BREAK.replace("(?![ -~])", ""))),
        "strip": (C.strip_ws(c), F.regexp_replace(c, f"^{T.SPACE}+|{T.SPACE}+$", "")), "blanks": (T.normalize_ws(c), F.trim(F.regexp_replace(c, f"{T.SPACE}+", " "))),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[x.eqNullSafe(y).alias(n) for n, (x, y) in pairs.items()])
    assert [n for n in pairs if rows.filter(f"NOT `{n}`").count()] == []
