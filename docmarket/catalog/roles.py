"""Role taxonomy on part labels with a small workshop lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmarket import lexicons as X
from docmarket.catalog import sql as S
from docmarket.functions import text as T
from docmarket.operators import taxonomy as R
from docmarket.registry import query
from docmarket.roles import RoleLexicon, clean
from docmarket.sources.tables import table

LEX = RoleLexicon(
    domains={"ring engineer": "metal", "bolt engineer": "metal", "gear specialist": "motion", "widget designer": "craft", "anvil analyst": "study"},
    synonyms={"red ring": "ring engineer", "hot bolt engineer": "bolt engineer", "cold gear": "gear specialist", "new gizmo": "widget designer", "small rod designer": "widget designer"},
    search={
        "ring engineer": ("ring engineer", "small ring engineer", "blue rod engineer"), "bolt engineer": ("bolt engineer", "large bolt engineer"),
        "gear specialist": ("gear specialist", "old gear specialist", "hot gear"), "widget designer": ("widget designer", "blue widget designer"), "anvil analyst": ("anvil analyst", "old anvil analyst"),
    },
    production={"ring engineer": ("ring engineer", "ring developer"), "gear specialist": ("gear specialist", "gear"), "widget designer": ("widget designer", "widget")},
    keywords={"ring engineer": ("large ring", "ring"), "anvil analyst": ("cold anvil", "anvil"), "bolt engineer": ("small bolt",)},
    title_hints={"ring engineer": ("ring", "red ring"), "bolt engineer": ("bolt", "hot bolt"), "gear specialist": ("gear",), "widget designer": ("widget", "gizmo widget"), "anvil analyst": ("anvil", "old anvil")},
    market_hints={"ring engineer": ("ring", "plate", "red"), "gear specialist": ("gear", "hot"), "anvil analyst": ("anvil", "old", "economy")},
    primary_hints={"ring engineer": ("ring", "red"), "bolt engineer": ("bolt",), "gear specialist": ("gear",), "anvil analyst": ("anvil", "ring")},
    signals={"ring engineer": ("rod", "round"), "bolt engineer": ("thread", "small"), "gear specialist": ("gear", "wheel", "new"), "anvil analyst": ("anvil", "iron")},
    adjacent={"ring engineer": ("bolt engineer",), "gear specialist": ("ring engineer", "widget designer")},
    rules=(((("plate",), ("engineer", "specialist")), "bolt engineer"), ((("gizmo",), ("designer",)), "widget designer")),
    boosts=((("old", "new"), "anvil analyst", 1.75), (("gizmo",), "widget designer", 1.5)),
    domain_words=(("metal", 1.25, ("rod", "plate"), ()), ("motion", 0.8, ("gear", "hot"), ()), ("study", 1.4, ("old", "cold"), ("analyst",)), ("craft", 1.0, ("designer",), ())),
    domain_market={"metal": ("iron", "plate"), "motion": ("wheel",)}, domain_primary={"metal": ("iron",), "study": ("notes",)},
    negative={"metal": ("promo", "widget"), "motion": ("economy",)},
    phrase_hints=(("hot plate", "market", ("steam",)), ("old", "market", ("relic",)), ("blue", "primary", ("sky",)), ("red", "title", ("crimson ring",))),
    models={"ring engineer": ("red", "Round-Ring", "plate"), "anvil analyst": ("anvil",)}, extra_terms={"ring engineer": ("polish",)},
    domain_models={"metal": ("iron", "weld"), "motion": ("axle",)}, domain_extra={"metal": ("paint",)},
    templates={"metal": ("{specialty} engineer", "{specialty} smith", "bolt engineer"), "motion": ("{specialty} specialist", "gear specialist")},
    domain_heads={"metal": ("engineer", "smith"), "study": ("analyst",)}, sparse=("widget designer",),
)

SUFFIXES = ("Engineer", "designer", "senior Analyst", "specialist", "", "PROMO lead")
LABELS_SQL = f"""parts AS (SELECT p_partkey, trim(CASE WHEN p_partkey % 13 = 0 THEN replace(p_name, ' ', '') ELSE p_name END || ' ' || (['Engineer', 'designer', 'senior Analyst', 'specialist', '', 'PROMO lead'])[CAST(p_partkey % 6 AS BIGINT) + 1]
    || CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE '' END) AS label, p_type, p_brand FROM part),
  labels AS (SELECT label, {S.clean_label('label')} AS cleaned FROM (SELECT DISTINCT label FROM parts))"""


def parts_frame(spark, sf):
    key = F.col("p_partkey")
    name = F.when(key % 13 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    suffix = F.element_at(T.lit_array(SUFFIXES), (key % 6 + 1).cast("int"))
    label = F.trim(F.concat(name, F.lit(" "), suffix, F.when(key % 17 == 0, "x").otherwise("")))
    return table(spark, sf, "part").select("p_partkey", label.alias("label"), "p_type", "p_brand")


def labels_frame(spark, sf):
    return R.distinct_labels(parts_frame(spark, sf), "label")


def _pairs(cols, d):
    return S.values(cols, sorted(d.items()))


SYN, COMPACT, ALIAS = LEX.all_synonyms(), LEX.compact_map(), LEX.alias_map()
EXACT = {}
for _f in LEX.families:
    for _k in LEX.keywords.get(_f, ()):
        EXACT.setdefault(clean(_k), _f)
KEYWORD_ROWS = [(clean(k), f, i) for i, f in enumerate(LEX.families) for k in LEX.keywords.get(f, ())]
TOK = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda t: length(t) > 2 AND t NOT IN {S.in_list(T.ROLE_STOPWORDS + T.ROLE_GENERIC_TOKENS)}))"
FAMILY_SQL = "fam AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {S.q(f)}, {S.q(LEX.domains[f])}, {S.str_list([w for w in clean(f).split() if w in LEX.heads])}, {S.str_list(LEX.phrases(f))}, {S.str_list(LEX.signal_bank(f))})" for i, f in enumerate(LEX.families)
) + ") AS t(ord, role, domain, heads, phrases, signals))"


def rule_sql(words: str) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"list_has_any({words}, {S.str_list(g)})" for g in groups) + f" THEN {S.q(role)}" for groups, role in LEX.rules) + " END"


def ratio_sql(name: str, names: dict, label: str, bar: str) -> str:
    """Closest name of each label by matching blocks: common runs of every pair, then blocks found by recursion."""
    return f"""{name}p AS MATERIALIZED (SELECT row_number() OVER () AS pid, *, length(a)::BIGINT AS na, length(b)::BIGINT AS nb FROM
    (SELECT label, {label} AS b, k AS a, role, {bar} AS bar FROM lk JOIN {_pairs(['k', 'role'], names)} n ON 2.0::DOUBLE * least(length(k), length({label})) / (length(k) + length({label})) >= {bar} WHERE {label} <> '')),
  {name}c AS (SELECT pid, i, j FROM {name}p, range(1, 80) AS r(i), range(1, 80) AS q(j) WHERE i <= na AND j <= nb AND substr(a, i, 1) = substr(b, j, 1)),
  {name}i AS (SELECT *, i - row_number() OVER (PARTITION BY pid, i - j ORDER BY i) AS island FROM {name}c),
  {name}r AS MATERIALIZED (SELECT pid, i, j, count(*) OVER (PARTITION BY pid, i - j, island ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM {name}i),
  {name}b(pid, a0, a1, b0, b1, gain) AS (SELECT pid, 1::BIGINT, na + 1, 1::BIGINT, nb + 1, 0::BIGINT FROM {name}p
    UNION ALL SELECT pid, CASE WHEN side THEN x.i + x.k ELSE a0 END, CASE WHEN side THEN a1 ELSE x.i END, CASE WHEN side THEN x.j + x.k ELSE b0 END, CASE WHEN side THEN b1 ELSE x.j END, CASE WHEN side THEN 0 ELSE x.k END
    FROM (SELECT pid, a0, a1, b0, b1, max(struct_pack(k := least(k, a1 - i, b1 - j), ni := -i, nj := -j)) AS m FROM {name}b JOIN {name}r r USING (pid) WHERE i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY pid, a0, a1, b0, b1),
      LATERAL (SELECT struct_pack(i := -m.ni, j := -m.nj, k := m.k) AS x), (VALUES (true), (false)) s(side)),
  {name}m AS (SELECT pid, sum(gain) AS n FROM {name}b GROUP BY pid),
  {name} AS (SELECT label, arg_max(role, struct_pack(ratio := ratio, a := a)) AS role FROM (SELECT *, 2.0::DOUBLE * n / (na + nb) AS ratio FROM {name}p JOIN {name}m USING (pid)) WHERE ratio >= bar GROUP BY label)"""


CLOSE_SQL = ratio_sql("fs_", ALIAS, "cleaned", "CASE WHEN contains(cleaned, ' ') THEN 0.9::DOUBLE ELSE 0.82::DOUBLE END") + ",\n  " + ratio_sql("fg_", {k: ALIAS[p] for k, p in COMPACT.items()}, "ck", "0.9::DOUBLE") + """,
  fz AS (SELECT label, coalesce(s.role, g.role) AS role FROM fs_ s FULL JOIN fg_ g USING (label))"""
NORMAL_SQL = f"""{LABELS_SQL}, {FAMILY_SQL},
  lk AS (SELECT label, cleaned, replace(cleaned, ' ', '') AS ck, string_split(cleaned, ' ') AS w, {TOK('cleaned')} AS tk FROM labels),
  {CLOSE_SQL},
  sg0 AS (SELECT label, role, ord, CASE WHEN list_contains(phrases, cleaned) THEN 12.0 ELSE 0 END + len(list_filter(phrases, lambda p: contains(p, ' ') AND contains(cleaned, p))) * 4.5 + len(list_intersect(tk, signals)) * 1.6 AS score FROM lk CROSS JOIN fam),
  sg1 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rn, lead(score) OVER (PARTITION BY label ORDER BY score DESC, ord) AS nxt FROM sg0),
  sg AS (SELECT label, role FROM sg1 WHERE rn = 1 AND score >= 2.4 AND score >= nxt + 0.7),
  lo AS (SELECT label, arg_max(role, struct_pack(n := length(k), o := -ord)) AS role FROM lk JOIN {S.values(['k', 'role', 'ord'], KEYWORD_ROWS)} kw ON contains(' ' || cleaned || ' ', ' ' || k || ' ') GROUP BY label),
  ph AS (SELECT label, phrase FROM lk JOIN {_pairs(['ck', 'phrase'], COMPACT)} c USING (ck) WHERE phrase <> cleaned),
  norm AS (SELECT lk.label, lk.cleaned, coalesce(s.role, sc.role, ex.role, {rule_sql('w')}, fz.role, sg.role, lo.role, lk.cleaned) AS normalized, coalesce(phrase, lk.cleaned) AS expanded
    FROM lk LEFT JOIN {_pairs(['k', 'role'], SYN)} s ON s.k = lk.cleaned LEFT JOIN ph ON ph.label = lk.label LEFT JOIN {_pairs(['k', 'role'], SYN)} sc ON sc.k = phrase
    LEFT JOIN {_pairs(['k', 'role'], EXACT)} ex ON ex.k = lk.cleaned LEFT JOIN fz ON fz.label = lk.label LEFT JOIN sg ON sg.label = lk.label LEFT JOIN lo ON lo.label = lk.label)"""


@query("F1_normalize_role", f"WITH RECURSIVE {NORMAL_SQL} SELECT label, normalized, expanded FROM norm")
def f1(spark, sf):
    return R.normalize_role(labels_frame(spark, sf), LEX).select("label", "normalized", "expanded")


@query("F2_fuzzy_alias", f"WITH RECURSIVE {NORMAL_SQL} SELECT label, role FROM fz")
def f2(spark, sf):
    return R.fuzzy_alias(labels_frame(spark, sf), LEX).select("label", "close.role").filter("role IS NOT NULL")


ORDER = LEX.domain_order()
DOMAIN_SQL = "dom AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {S.q(d)}, {S.str_list(LEX.domain_bank(d))})" for i, d in enumerate(ORDER)) + ") AS t(ord, domain, signals))"
BONUS = " + ".join(
    f"CASE WHEN domain = {S.q(d)} AND list_has_any(string_split(expanded, ' '), {S.str_list(a)}) AND list_has_any(string_split(expanded, ' '), {S.str_list(b or a)}) THEN {p} ELSE 0 END" for d, p, a, b in LEX.domain_words
)
KNOWN_DOMAIN = "CASE normalized " + " ".join(f"WHEN {S.q(f)} THEN {S.q(d)}" for f, d in LEX.domains.items()) + " END"
DOM_SQL = f"""{DOMAIN_SQL}, ds AS (SELECT label, domain, ord, len(list_intersect({TOK('expanded')}, signals)) * 1.25 + {BONUS} AS score FROM norm CROSS JOIN dom),
  dw AS (SELECT label, domain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rn FROM ds) WHERE rn = 1 AND score >= 1.2),
  dm AS (SELECT n.*, coalesce({KNOWN_DOMAIN}, dw.domain) AS domain FROM norm n LEFT JOIN dw USING (label))"""
SKIP = sorted(set(T.ROLE_STOPWORDS) | set(LEX.heads) | set(LEX.seniority) | set(T.ROLE_GENERIC_TOKENS))
# keep the first mention of each word: list_distinct does not keep order
FIRST = lambda l: f"list_filter({l}, lambda w, i: list_position({l}, w) = i)"
PICK = lambda c, words: FIRST(f"list_filter(string_split({c}, ' '), lambda w: w IN {S.in_list(words)})")
MEAN = lambda c: FIRST(f"list_filter(string_split({c}, ' '), lambda w: w <> '' AND w NOT IN {S.in_list(SKIP)})")
PARTS_SQL = f"""{DOM_SQL}, dc AS (SELECT *, CASE WHEN len({PICK('expanded', LEX.heads)}) > 0 THEN {PICK('expanded', LEX.heads)} ELSE {PICK('normalized', LEX.heads)} END AS heads, {PICK('expanded', LEX.seniority)} AS seniority,
  CASE WHEN len({MEAN('expanded')}) > 0 THEN {MEAN('expanded')} ELSE {MEAN('normalized')} END AS specialty FROM dm)"""


@query("F3_infer_domain", f"WITH RECURSIVE {NORMAL_SQL}, {DOM_SQL} SELECT label, coalesce(domain, 'none') AS domain FROM dm")
def f3(spark, sf):
    norm = R.normalize_role(labels_frame(spark, sf), LEX)
    return norm.select("label", F.coalesce(R.infer_domain(F.col("expanded"), F.col("normalized"), LEX), F.lit("none")).alias("domain"))


VARIANTS = "MAP {" + ", ".join(f"{S.q(h)}: {S.str_list(v)}" for h, v in LEX.head_variants.items()) + "}"
BOOST = " + ".join(f"CASE WHEN role = {S.q(r)} AND list_has_any(w, {S.str_list(ws)}) THEN {p} ELSE 0 END" for ws, r, p in LEX.boosts)
FAM_SQL = f"""{PARTS_SQL}, fx AS (SELECT *, string_split(expanded, ' ') AS w, {TOK('expanded')} AS tk, list_distinct(list_concat(heads, flatten(list_transform(heads, lambda h: coalesce(({VARIANTS})[h], [h]))))) AS wide FROM dc),
  fs AS (SELECT label, role, ord, CASE WHEN list_contains(phrases, expanded) THEN 12.0 ELSE 0 END + len(list_filter(phrases, lambda p: contains(p, ' ') AND contains(expanded, p))) * 4.0
     + CASE WHEN fx.domain IS NULL THEN 0 WHEN fam.domain = fx.domain THEN 3.0 ELSE -1.5 END
     + CASE WHEN list_has_any(wide, fam.heads) THEN len(list_intersect(wide, fam.heads)) * 3.5 WHEN len(wide) > 0 AND len(fam.heads) > 0 THEN -1.0 ELSE 0 END
     + len(list_intersect(tk, signals)) * 1.35 + len(list_intersect(specialty, signals)) * 2.1 + CASE WHEN list_has_any(specialty, w) THEN least(2.0, len(list_intersect(specialty, signals)) * 0.5) ELSE 0 END + {BOOST} AS score FROM fx CROSS JOIN fam),
  fr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) AS rn, lead(score) OVER (PARTITION BY label ORDER BY score DESC, ord) AS nxt FROM fs),
  fw AS (SELECT label, role FROM fr WHERE rn = 1 AND score >= 3.0 AND score >= greatest(nxt, 0) + 0.6),
  prof0 AS (SELECT dc.*, CASE WHEN normalized IN {S.in_list(LEX.families)} THEN normalized ELSE fw.role END AS family FROM dc LEFT JOIN fw USING (label)),
  prof AS (SELECT *, coalesce(family, normalized) AS role, coalesce(CASE coalesce(family, normalized) {" ".join(f"WHEN {S.q(f)} THEN {S.q(d)}" for f, d in LEX.domains.items())} END, domain) AS role_domain, {TOK("expanded || ' ' || normalized")} AS tokens FROM prof0)"""


def profiles_frame(spark, sf):
    return R.role_profile(labels_frame(spark, sf), LEX)


@query("F4_infer_family", f"WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL} SELECT label, coalesce(family, 'none') AS family FROM prof")
def f4(spark, sf):
    return profiles_frame(spark, sf).select("label", F.coalesce("family", F.lit("none")).alias("family"))


JOIN = lambda c: f"coalesce(array_to_string({c}, ' '), '') AS {c}"


@query("F5_decompose", f"WITH RECURSIVE {NORMAL_SQL}, {PARTS_SQL} SELECT label, {JOIN('heads')}, {JOIN('seniority')}, {JOIN('specialty')} FROM dc")
def f5(spark, sf):
    norm = R.normalize_role(labels_frame(spark, sf), LEX)
    parts = R.decompose(F.col("expanded"), F.col("normalized"), LEX)
    return norm.select("label", *[F.array_join(c, " ").alias(n) for n, c in parts.items()])


@query(
    "F6_role_profile",
    f"WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL} SELECT label, cleaned, expanded, normalized, coalesce(domain, 'none') AS domain, role, coalesce(role_domain, 'none') AS role_domain, coalesce(array_to_string(list_sort(tokens), ' '), '') AS tokens FROM prof",
)
def f6(spark, sf):
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return profiles_frame(spark, sf).select("label", "cleaned", "expanded", "normalized", none("domain"), "role", none("role_domain"), F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


def _map_sql(d, key):
    return "CASE " + key + " " + " ".join(f"WHEN {S.q(k)} THEN {S.str_list(sorted(set(v)))}" for k, v in d.items()) + " ELSE [] END" if d else "[]"


def _derived_sql(kind):
    parts = []
    for p, k, h in LEX.phrase_hints:
        if k == kind:
            cond = f"contains(expanded, {S.q(p)})" if kind == "title" or " " in p else f"(list_contains(string_split(expanded, ' '), {S.q(p)}) OR list_contains(specialty, {S.q(p)}))"
            parts.append(f"CASE WHEN {cond} THEN {S.str_list(h)} ELSE [] END")
    return " || ".join(parts) if parts else "[]"


TELLING = f"(expanded <> normalized AND len(list_filter(string_split(expanded, ' '), lambda w: w <> '' AND w NOT IN {S.in_list(T.ROLE_STOPWORDS)} AND w NOT IN {S.in_list(T.ROLE_GENERIC_TOKENS)})) > 0)"
HINTS_SQL = f"""hints AS (SELECT *, list_sort(list_distinct({_map_sql(LEX.market_hints, 'role')} || {_map_sql(LEX.domain_market, 'domain')} || {_derived_sql('market')})) AS market_hints,
  list_sort(list_distinct({_map_sql(LEX.primary_hints, 'role')} || {_map_sql(LEX.domain_primary, 'domain')} || {_derived_sql('primary')})) AS primary_hints,
  list_sort(list_distinct({_map_sql(LEX.title_hints, 'role')} || CASE WHEN {TELLING} THEN [expanded] ELSE [] END || {_derived_sql('title')})) AS title_hints, {_map_sql(LEX.negative, 'role_domain')} AS negative_hints FROM prof)"""


def hints_frame(spark, sf):
    return R.role_hints(profiles_frame(spark, sf), LEX)


HINT_COLS = ("market_hints", "primary_hints", "title_hints", "negative_hints")


@query("F7_role_hints", f"WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL}, {HINTS_SQL} SELECT label, " + ", ".join(f"coalesce(array_to_string({c}, '|'), '') AS {c}" for c in HINT_COLS) + " FROM hints")
def f7(spark, sf):
    return hints_frame(spark, sf).select("label", *[F.array_join(c, "|").alias(c) for c in HINT_COLS])


def _ordered_sql(d, key):
    return "CASE " + key + " " + " ".join(f"WHEN {S.q(k)} THEN {S.str_list(v)}" for k, v in d.items()) + " END"


TIDY = lambda l: FIRST(f"list_filter(list_transform({l}, lambda t: {S.clean_label('t')}), lambda t: t <> '')")
MODEL_SQL = f"""mdl0 AS (SELECT label, {_ordered_sql(LEX.models, 'role')} AS mb, coalesce({_ordered_sql(LEX.extra_terms, 'role')}, []) AS mx, coalesce({_ordered_sql(LEX.domain_models, 'role_domain')}, []) AS db, coalesce({_ordered_sql(LEX.domain_extra, 'role_domain')}, []) AS dx,
    {_map_sql(LEX.primary_hints, 'role')} AS fp, {_map_sql(LEX.market_hints, 'role')} AS fm, primary_hints, market_hints FROM hints),
  mdl AS (SELECT label, CASE WHEN mb IS NOT NULL THEN mb || fp || fm ELSE db || primary_hints || market_hints END AS b, CASE WHEN mb IS NOT NULL THEN mb || mx || mb || fp || fm ELSE db || dx || db || primary_hints || market_hints END AS r FROM mdl0),
  mdl2 AS (SELECT label, {TIDY('b')} AS baseline_terms, {TIDY('r')} AS recommended_terms FROM mdl)"""


@query("F8_role_term_model", f"WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL}, {HINTS_SQL}, {MODEL_SQL} SELECT label, coalesce(array_to_string(baseline_terms, '|'), '') AS baseline, coalesce(array_to_string(recommended_terms, '|'), '') AS recommended FROM mdl2")
def f8(spark, sf):
    out = R.role_term_model(hints_frame(spark, sf), LEX)
    return out.select("label", F.array_join("baseline_terms", "|").alias("baseline"), F.array_join("recommended_terms", "|").alias("recommended"))


# A part's query is the label of the part before it.
ALIGN_SQL = "CASE " + " ".join(f"WHEN q.role = {S.q(a)} AND t.role = {S.q(b)} THEN 1" for a, bs in LEX.adjacent.items() for b in bs)
NEG_HIT = f"len(list_filter(q.negative_hints, lambda h: contains(' ' || t.cleaned || ' ', ' ' || h || ' '))) > 0"


@query(
    "F9_role_alignment",
    f"""WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL}, {HINTS_SQL} SELECT a.p_partkey, CASE WHEN {NEG_HIT} THEN -3 WHEN q.role = t.role THEN 3 ELSE {ALIGN_SQL}
      WHEN t.role IN {S.in_list(LEX.families)} AND q.role_domain = t.role_domain THEN -2 ELSE 0 END END AS alignment
    FROM parts a JOIN parts b ON b.p_partkey = a.p_partkey - 1 JOIN hints t ON t.label = a.label JOIN hints q ON q.label = b.label""",
)
def f9(spark, sf):
    parts, hints = parts_frame(spark, sf), hints_frame(spark, sf)
    t = hints.select("label", F.col("role").alias("t_role"), F.col("role_domain").alias("t_domain"), F.col("cleaned").alias("t_clean"))
    q = hints.select(F.col("label").alias("q_label"), F.col("role").alias("q_role"), F.col("role_domain").alias("q_domain"), "negative_hints")
    before = parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("label").alias("q_label"))
    pairs = parts.select("p_partkey", "label").join(before, ["p_partkey"]).join(t, ["label"]).join(q, ["q_label"])
    hit = F.exists("negative_hints", lambda h: F.contains(F.concat(F.lit(" "), F.col("t_clean"), F.lit(" ")), F.concat(F.lit(" "), h, F.lit(" "))))
    return pairs.select("p_partkey", R.role_alignment(F.col("q_role"), F.col("t_role"), F.col("q_domain"), F.col("t_domain"), hit, LEX).alias("alignment"))


@query("F10_expand_query")
def f10(spark, sf):
    return R.expand_query(profiles_frame(spark, sf), LEX)


@query(
    "F12_query_class",
    f"""WITH RECURSIVE {NORMAL_SQL}, {FAM_SQL}, {HINTS_SQL}, c AS (SELECT *, coalesce(CASE role WHEN 'ring engineer' THEN 'hard' WHEN 'bolt engineer' THEN 'hard' WHEN 'gear specialist' THEN 'moving' END, role_domain, 'general') AS family_group,
      normalized = 'widget designer' AS sparse, coalesce(role_domain = 'study', false) AS business, CASE WHEN expanded = normalized THEN true WHEN len(string_split(expanded, ' ')) < 2 THEN false ELSE list_contains(list_transform(title_hints, lambda h: {S.clean_label('h')}), expanded) END AS strict,
      CASE WHEN coalesce(domain = 'study', false) THEN false ELSE len(specialty) > 0 AND (normalized = 'gear specialist' OR expanded <> normalized) END AS needs_specialty FROM hints),
    d AS (SELECT *, family_group = 'hard' AS dense FROM c)
    SELECT label, family_group, dense, sparse, business, strict, needs_specialty, CASE WHEN sparse THEN 4 WHEN dense THEN 15 ELSE 12 END AS live_target, CASE WHEN sparse THEN 1 ELSE 10 END AS display_floor, CASE WHEN sparse THEN 1 WHEN dense THEN 8 ELSE 4 END AS partial_floor FROM d""",
)
def f12(spark, sf):
    profiles = hints_frame(spark, sf).withColumn("variations", T.lit_array([]))
    groups = {"hard": ("ring engineer", "bolt engineer"), "moving": ("gear specialist",)}
    out = R.query_class(profiles, LEX, groups, ("hard",), ("gear specialist",), ("study",))
    return out.withColumns(R.live_floors(F.col("sparse"), F.col("dense"), F.lit(20)))
