"""Role taxonomy on distinct labels: normal form, domain, family, hints, term model, query expansion.

Labels repeat heavily (one title may be a third of all rows), so everything runs on
the distinct labels, found with partial aggregation, and is joined back by the caller.
Scores over families and domains are computed inside the row from literal arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmarket.functions import text as T
from docmarket.operators.similarity import add_closest
from docmarket.roles import RoleLexicon, clean
from docmarket.sources.tables import values_frame

# --- fixed values -------------------------------------------------------------
FUZZY_LONG, FUZZY_SHORT = 0.9, 0.82
SIGNAL_MIN, SIGNAL_MARGIN = 2.4, 0.7
DOMAIN_MIN = 1.2
FAMILY_MIN, FAMILY_MARGIN = 3.0, 0.6
# ------------------------------------------------------------------------------


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """(label, cleaned) for the distinct labels of a table."""
    return df.select(F.coalesce(F.col(label), F.lit("")).alias("label")).distinct().withColumn("cleaned", T.clean_label(F.col("label")))


def _lookup(df: DataFrame, spark: SparkSession, key: str, table: dict[str, str], out: str) -> DataFrame:
    if not table:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.join(values_frame(spark, [key, out], sorted(table.items())), [key], "left")


def word_rule(words: Column, lex: RoleLexicon) -> Column:
    """Role of the first rule all of whose word groups meet the label."""
    out = F.lit(None).cast("string")
    for groups, role in reversed(lex.rules):
        hit = F.lit(True)
        for group in groups:
            hit = hit & F.arrays_overlap(words, T.lit_array(group))
        out = F.when(hit, F.lit(role)).otherwise(out)
    return out


def fuzzy_alias(labels: DataFrame, lex: RoleLexicon, wanted: Column | None = None) -> DataFrame:
    """labels (cleaned) with ``close``: struct(alias, role) of the alias most similar by matching blocks, or null.

    At least 0.9 for labels of two or more words, 0.82 for one word; else the glued label is held
    against the glued aliases, at least 0.9. Of equally similar aliases the last in order. The alias list is bounded;
    only aliases that lengths and character counts allow are compared, and only in rows where ``wanted`` holds.
    """
    aliases = lex.alias_map()
    glued = {k: aliases[p] for k, p in lex.compact_map().items()}
    df = add_closest(labels, "__spelled", F.col("cleaned"), aliases, lambda c: F.when(F.instr(c, " ") > 0, FUZZY_LONG).otherwise(FUZZY_SHORT), wanted)
    missed = F.col("__spelled").isNull() if wanted is None else F.col("__spelled").isNull() & wanted
    df = add_closest(df, "__glued", F.replace("cleaned", F.lit(" "), F.lit("")), glued, lambda c: F.lit(FUZZY_LONG), missed)
    best = F.coalesce("__spelled", "__glued")
    return df.withColumn("close", F.when(best.isNotNull(), F.struct(best["name"].alias("alias"), best["value"].alias("role")))).drop("__spelled", "__glued")


def _family_structs(lex: RoleLexicon) -> Column:
    rows = []
    for i, fam in enumerate(lex.families):
        rows.append(
            F.struct(
                F.lit(-i).alias("order"), F.lit(fam).alias("role"), F.lit(lex.domains[fam]).alias("domain"), T.lit_array([w for w in clean(fam).split() if w in lex.heads]).alias("heads"),
                T.lit_array(lex.phrases(fam)).alias("phrases"), T.lit_array(lex.signal_bank(fam)).alias("signals"),
                T.lit_array(sorted(lex.keywords and {clean(k) for k in lex.keywords.get(fam, ())} or set())).alias("keywords"),
            )
        )
    return F.array(*rows)


def _winner(scored: Column, low: float, margin: float) -> Column:
    """Role of the best score if it is high enough and clear of the second."""
    def pick(s: Column) -> Column:
        top = F.get(s, 0)
        second = F.greatest(F.coalesce(F.get(s, 1)["score"], F.lit(0.0)), F.lit(0.0))
        return F.when((top["score"] >= low) & (top["score"] >= second + F.lit(margin - 1e-9)), top["role"])

    return T.let(F.sort_array(scored, asc=False), pick)


def signal_role(cleaned: Column, lex: RoleLexicon) -> Column:
    """Best family by phrase and token hits."""

    def score(c: Column) -> Column:
        def one(toks: Column, words: Column) -> Column:
            def total(f: Column) -> Column:
                inside = F.size(F.filter(f["phrases"], lambda p: F.contains(p, F.lit(" ")) & F.contains(c, p)))
                word_bonus = (
                    F.when((f["domain"] == "software") & F.arrays_overlap(words, T.lit_array(("developer", "engineer", "frontend", "backend"))), 0.8)
                    .when((f["domain"] == "data") & F.arrays_overlap(words, T.lit_array(("analyst", "analytics", "data", "reporting", "bi"))), 0.8)
                    .when((f["domain"] == "security") & F.arrays_overlap(words, T.lit_array(("security", "cyber"))), 1.1).otherwise(0.0)
                )
                s = F.when(F.array_contains(f["phrases"], c), 12.0).otherwise(0.0) + inside * F.lit(4.5) + F.size(F.array_intersect(toks, f["signals"])) * F.lit(1.6) + word_bonus
                return F.struct(F.round(s, 6).alias("score"), f["order"].alias("order"), f["role"].alias("role"))

            return _winner(F.transform(_family_structs(lex), total), SIGNAL_MIN, SIGNAL_MARGIN)

        return T.let(T.role_tokens(c), lambda t: T.let(F.split(c, " "), lambda w: one(t, w)))

    return T.let(cleaned, score)


def loose_keyword(cleaned: Column, lex: RoleLexicon) -> Column:
    """Family of the longest keyword that occurs in the label as whole words."""
    rows = [(len(k), -i, k, fam) for i, fam in enumerate(lex.families) for k in {clean(k) for k in lex.keywords.get(fam, ())} if k]
    if not rows:
        return F.lit(None).cast("string")
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(o).alias("o"), F.lit(f" {k} ").alias("k"), F.lit(fam).alias("role")) for n, o, k, fam in sorted(rows)])
    hits = T.let(F.concat(F.lit(" "), cleaned, F.lit(" ")), lambda padded: F.filter(table, lambda x: F.contains(padded, x["k"])))
    return F.array_max(hits)["role"]


def normalize_role(labels: DataFrame, lex: RoleLexicon) -> DataFrame:
    """labels (label, cleaned) with ``normalized`` and ``expanded`` (a glued label spelled out).

    First of: synonym, glued synonym, exact keyword, word rule, close alias, signal score,
    keyword inside, the cleaned label itself.
    """
    spark = labels.sparkSession
    syn, compact = lex.all_synonyms(), lex.compact_map()
    exact: dict[str, str] = {}
    for fam in lex.families:
        for k in lex.keywords.get(fam, ()):
            exact.setdefault(clean(k), fam)
    df = labels.withColumn("compact_key", F.replace("cleaned", F.lit(" "), F.lit("")))
    df = _lookup(df, spark, "cleaned", syn, "r_synonym")
    df = _lookup(df, spark, "compact_key", compact, "phrase")
    df = df.withColumn("phrase", F.when(F.col("phrase") != F.col("cleaned"), F.col("phrase")))
    df = _lookup(df, spark, "phrase", {p: syn[p] for p in compact.values() if p in syn}, "r_compact")
    df = _lookup(df, spark, "cleaned", exact, "r_keyword")
    words = F.split("cleaned", " ")
    # Only labels that the tables and rules miss are compared with aliases; coalesce stops at the first hit.
    df = df.withColumn("r_known", F.coalesce("r_synonym", "r_compact", "r_keyword", word_rule(words, lex)))
    df = fuzzy_alias(df, lex, F.col("r_known").isNull())
    role = F.coalesce(
        "r_known", "close.role", signal_role(F.col("cleaned"), lex),
        loose_keyword(F.col("cleaned"), lex), "cleaned",
    )
    return df.select("label", "cleaned", role.alias("normalized"), F.coalesce("phrase", "cleaned").alias("expanded"))


def infer_domain(expanded: Column, normalized: Column, lex: RoleLexicon) -> Column:
    """Domain of the role if it is known, else the best of signal hits and word groups (at least 1.2)."""
    order = lex.domain_order()
    table = F.array(
        *[F.struct(F.lit(-i).alias("order"), F.lit(d).alias("domain"), T.lit_array(lex.domain_bank(d)).alias("signals")) for i, d in enumerate(order)]
    )
    bonus = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(float(p)).alias("points"), T.lit_array(a).alias("a"), T.lit_array(b or a).alias("b")) for d, p, a, b in lex.domain_words]) if lex.domain_words else None

    def score(c: Column) -> Column:
        def one(toks: Column, words: Column) -> Column:
            def total(d: Column) -> Column:
                s = F.size(F.array_intersect(toks, d["signals"])) * F.lit(1.25)
                if bonus is not None:
                    s = s + F.aggregate(
                        bonus, F.lit(0.0), lambda acc, w: acc + F.when((w["domain"] == d["domain"]) & F.arrays_overlap(words, w["a"]) & F.arrays_overlap(words, w["b"]), w["points"]).otherwise(0.0)
                    )
                return F.struct(F.round(s, 6).alias("score"), d["order"].alias("order"), d["domain"].alias("domain"))

            return T.let(F.array_max(F.transform(table, total)), lambda t: F.when(t["score"] >= DOMAIN_MIN, t["domain"]))

        return T.let(T.role_tokens(c), lambda t: T.let(F.split(c, " "), lambda w: one(t, w)))

    known = F.try_element_at(T.lit_map(dict(lex.domains)), normalized)
    return F.coalesce(known, F.when(expanded != "", T.let(expanded, score)))


def _meaning(words: Column, lex: RoleLexicon) -> Column:
    skip = set(T.ROLE_STOPWORDS) | set(lex.heads) | set(lex.seniority) | set(T.ROLE_GENERIC_TOKENS)
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*skip)))


def decompose(expanded: Column, normalized: Column, lex: RoleLexicon) -> dict[str, Column]:
    """Head, seniority and specialty words; the role's own where the label has none."""
    own, role = F.split(expanded, " "), F.split(normalized, " ")
    pick = lambda arr, allowed: F.array_distinct(F.filter(arr, lambda w: w.isin(*allowed)))
    first = lambda a, b: T.let(a, lambda x: F.when(F.size(x) > 0, x).otherwise(b))
    return {
        "heads": first(pick(own, lex.heads), pick(role, lex.heads)), "seniority": pick(own, lex.seniority), "specialty": first(_meaning(own, lex), _meaning(role, lex)),
    }


def infer_family(expanded: Column, normalized: Column, domain: Column, heads: Column, specialty: Column, lex: RoleLexicon) -> Column:
    """Family of a label: its role if that is one, else the best and clear score over all families."""
    variants = F.array(*[F.struct(F.lit(h).alias("h"), T.lit_array(v).alias("v")) for h, v in lex.head_variants.items()])
    boosts = F.array(*[F.struct(T.lit_array(w).alias("words"), F.lit(r).alias("role"), F.lit(float(p)).alias("points")) for w, r, p in lex.boosts]) if lex.boosts else None

    def score(x: Column) -> Column:
        c, toks, words, hs, spec, dom = x["c"], x["toks"], x["words"], x["heads"], x["spec"], x["dom"]

        def total(f: Column) -> Column:
            inside = F.size(F.filter(f["phrases"], lambda p: F.contains(p, F.lit(" ")) & F.contains(c, p)))
            s = F.when(F.array_contains(f["phrases"], c), 12.0).otherwise(0.0) + inside * F.lit(4.0)
            s = s + F.when(dom.isNull(), 0.0).when(f["domain"] == dom, 3.0).otherwise(-1.5)
            shared = F.size(F.array_intersect(hs, f["heads"]))
            s = s + F.when(shared > 0, shared * F.lit(3.5)).when((F.size(hs) > 0) & (F.size(f["heads"]) > 0), -1.0).otherwise(0.0)
            special = F.size(F.array_intersect(spec, f["signals"]))
            s = s + F.size(F.array_intersect(toks, f["signals"])) * F.lit(1.35) + special * F.lit(2.1)
            s = s + F.when(F.arrays_overlap(spec, words), F.least(F.lit(2.0), special * F.lit(0.5))).otherwise(0.0)
            if boosts is not None:
                s = s + F.aggregate(boosts, F.lit(0.0), lambda acc, b: acc + F.when((b["role"] == f["role"]) & F.arrays_overlap(words, b["words"]), b["points"]).otherwise(0.0))
            return F.struct(F.round(s, 6).alias("score"), f["order"].alias("order"), f["role"].alias("role"))

        return _winner(F.transform(_family_structs(lex), total), FAMILY_MIN, FAMILY_MARGIN)

    wide = T.let(heads, lambda hs: F.array_union(hs, F.flatten(F.transform(F.filter(variants, lambda v: F.array_contains(hs, v["h"])), lambda v: v["v"]))))
    state = F.struct(expanded.alias("c"), T.role_tokens(expanded).alias("toks"), F.split(expanded, " ").alias("words"), wide.alias("heads"), specialty.alias("spec"), domain.alias("dom"))
    return F.when(normalized.isin(*lex.families), normalized).when(expanded != "", T.let(state, score))


def role_profile(labels: DataFrame, lex: RoleLexicon) -> DataFrame:
    """One row per distinct label: cleaned, expanded, normalized, domain, heads, seniority, specialty, family, role_domain, tokens."""
    df = normalize_role(labels, lex)
    df = df.withColumn("domain", infer_domain(F.col("expanded"), F.col("normalized"), lex)).withColumns(decompose(F.col("expanded"), F.col("normalized"), lex))
    df = df.withColumn("family", infer_family(F.col("expanded"), F.col("normalized"), F.col("domain"), F.col("heads"), F.col("specialty"), lex))
    role = F.coalesce("family", "normalized")
    return df.withColumns(
        {
            "role": role, "role_domain": F.coalesce(F.try_element_at(T.lit_map(dict(lex.domains)), role), F.col("domain")),
            "tokens": T.role_tokens(F.concat_ws(" ", "expanded", "normalized")),
        }
    )


def _table(spark, key: str, out: str, rows) -> DataFrame:
    """(key, array) lexicon rows as a local relation with exact size."""
    flat = [(k, "\x1f".join(sorted(set(v)))) for k, v in rows.items()] or [("", "")]
    return values_frame(spark, [key, "__v"], flat).select(key, F.filter(F.split("__v", "\x1f"), lambda x: x != "").alias(out))


def role_hints(profiles: DataFrame, lex: RoleLexicon) -> DataFrame:
    """Profiles with market, primary, title and negative hint arrays (bounded by the lexicon)."""
    spark = profiles.sparkSession
    df = profiles
    for out, fam, dom in (("market", lex.market_hints, lex.domain_market), ("primary", lex.primary_hints, lex.domain_primary), ("title", lex.title_hints, {})):
        df = df.join(_table(spark, "role", f"f_{out}", fam), ["role"], "left").join(_table(spark, "domain", f"d_{out}", dom), ["domain"], "left")
    df = df.join(_table(spark, "role_domain", "negative_hints", lex.negative), ["role_domain"], "left")
    none = T.lit_array([])

    def derived(kind: str) -> Column:
        rows = [(p, h) for p, k, h in lex.phrase_hints if k == kind]
        if not rows:
            return none
        table = F.array(*[F.struct(F.lit(p).alias("p"), T.lit_array(sorted(h)).alias("h")) for p, h in rows])
        inside = lambda x: F.contains(F.col("expanded"), x["p"]) if kind == "title" else F.when(F.contains(x["p"], F.lit(" ")), F.contains(F.col("expanded"), x["p"])).otherwise(
            F.array_contains(F.split("expanded", " "), x["p"]) | F.array_contains(F.col("specialty"), x["p"])
        )
        return F.flatten(F.transform(F.filter(table, inside), lambda x: x["h"]))

    words = F.filter(F.split("expanded", " "), lambda w: (w != "") & ~w.isin(*T.ROLE_STOPWORDS))
    telling = (F.size(words) > 0) & (F.col("expanded") != F.col("normalized")) & F.exists(words, lambda w: ~w.isin(*T.ROLE_GENERIC_TOKENS))
    own = F.when(telling, F.array("expanded")).otherwise(none)
    merge = lambda *parts: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts])))
    return df.select(
        *profiles.columns, merge(F.col("f_market"), F.col("d_market"), derived("market")).alias("market_hints"),
        merge(F.col("f_primary"), F.col("d_primary"), derived("primary")).alias("primary_hints"), merge(F.col("f_title"), own, derived("title")).alias("title_hints"),
        F.coalesce("negative_hints", none).alias("negative_hints"),
    )


def role_term_model(hints: DataFrame, lex: RoleLexicon) -> DataFrame:
    """Ordered baseline and recommended terms of each label (cleaned, first mention wins).

    A family with a model uses it and its own hints; other labels use their domain's
    defaults and all hints found for the label.
    """
    spark = hints.sparkSession
    ordered = lambda rows, key, out: values_frame(spark, [key, "__v"], [(k, "\x1f".join(v)) for k, v in rows.items()] or [("", "")]).select(key, F.split("__v", "\x1f").alias(out))
    df = hints.join(ordered(lex.models, "role", "m_base"), ["role"], "left").join(ordered(lex.extra_terms, "role", "m_more"), ["role"], "left")
    df = df.join(ordered(lex.domain_models, "role_domain", "d_base"), ["role_domain"], "left").join(ordered(lex.domain_extra, "role_domain", "d_more"), ["role_domain"], "left")
    df = df.join(_table(spark, "role", "f_primary", lex.primary_hints), ["role"], "left").join(_table(spark, "role", "f_market", lex.market_hints), ["role"], "left")
    none = T.lit_array([])
    or_none = lambda c: F.coalesce(F.col(c), none)
    modelled = F.col("m_base").isNotNull()
    primary = F.when(modelled, or_none("f_primary")).otherwise(F.col("primary_hints"))
    market = F.when(modelled, or_none("f_market")).otherwise(F.col("market_hints"))
    tidy = lambda *parts: F.array_distinct(F.filter(F.transform(F.concat(*parts), T.clean_label), lambda t: t != ""))
    base = F.when(modelled, or_none("m_base")).otherwise(or_none("d_base"))
    more = F.when(modelled, F.concat(or_none("m_base"), or_none("m_more"))).otherwise(F.concat(or_none("d_base"), or_none("d_more")))
    return df.select("label", tidy(base, primary, market).alias("baseline_terms"), tidy(more, base, primary, market).alias("recommended_terms"))


def role_alignment(q_role: Column, t_role: Column, q_domain: Column, t_domain: Column, negative_hit: Column, lex: RoleLexicon) -> Column:
    """3 same family, 1 adjacent, -2 another family of the same domain, 0 otherwise; -3 on a negative title hint."""
    pairs = [f"{a}|{b}" for a, bs in lex.adjacent.items() for b in bs]
    near = F.concat_ws("|", q_role, t_role).isin(*pairs) if pairs else F.lit(False)
    plain = (
        F.when((q_role == "") | (t_role == ""), 0).when(q_role == t_role, 3).when(near, 1)
        .when(t_role.isin(*lex.families) & q_domain.isNotNull() & (q_domain == t_domain), -2).otherwise(0)
    )
    return F.when(F.coalesce(negative_hit, F.lit(False)), -3).otherwise(plain)


def expand_query(profiles: DataFrame, lex: RoleLexicon, limit: int = 6) -> DataFrame:
    """(label, pos, variation): other wordings of a query that stay in its family, at most ``limit``.

    The lexicon's own phrases are profiled once, as a small DataFrame, so only those that
    resolve to the family they are listed under are offered.
    """
    spark = profiles.sparkSession
    listed = []
    for fam in lex.families:
        own = [*lex.search.get(fam, ()), *lex.production.get(fam, ()), *sorted(lex.title_hints.get(fam, ()))]
        listed += [(fam, i, clean(p)) for i, p in enumerate(own)]
    phrases = values_frame(spark, ["fam", "at", "label"], listed)
    resolved = role_profile(phrases.select("label").distinct().withColumn("cleaned", F.col("label")), lex).select("label", F.col("role").alias("r"))
    safe = phrases.join(resolved, ["label"]).filter("r = fam")
    # A family lists a bounded number of phrases.
    safe = safe.groupBy(F.col("fam").alias("role")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("safe"))
    fixed = values_frame(spark, ["role", "__v"], [(f, "\x1f".join(clean(v) for v in (lex.production.get(f) or (f,)))) for f in lex.families]).select("role", F.split("__v", "\x1f").alias("fixed"))
    heads = F.array(*[F.struct(F.lit(h).alias("h"), T.lit_array(v).alias("v")) for h, v in lex.head_variants.items()])
    dom_heads = F.coalesce(F.try_element_at(F.create_map(*[x for d, v in lex.domain_heads.items() for x in (F.lit(d), T.lit_array(v))]), F.col("domain")), T.lit_array(("engineer", "developer")))
    templates = F.coalesce(F.try_element_at(F.create_map(*[x for d, v in lex.templates.items() for x in (F.lit(d), T.lit_array(v))]), F.col("domain")), T.lit_array([]))
    none = T.lit_array([])
    own_heads = F.flatten(F.transform(F.col("heads"), lambda h: F.coalesce(F.get(F.transform(F.filter(heads, lambda v: v["h"] == h), lambda v: v["v"]), 0), F.array(h))))
    df = profiles.join(safe, ["role"], "left").join(fixed, ["role"], "left").withColumns(
        {"has_head": F.size("heads") > 0, "variants": F.array_distinct(F.when(F.size("heads") > 0, own_heads).otherwise(dom_heads)), "spec": F.array_join("specialty", " "), "templates": templates}
    )

    def build(x: Column) -> Column:
        cleaned, normalized, spec, variants, has_head = x["cleaned"], x["normalized"], x["spec"], x["variants"], x["has_head"]
        fits = lambda c: ~has_head | F.arrays_overlap(F.split(c, " "), variants)
        by_head = F.when(spec != "", F.transform(variants, lambda h: F.when(F.contains(spec, h), spec).otherwise(F.concat_ws(" ", spec, h)))).otherwise(none)
        by_template = F.when(spec != "", F.filter(F.transform(x["templates"], lambda t: F.replace(t, F.lit("{specialty}"), spec)), fits)).otherwise(none)
        safe_ones = F.filter(F.coalesce(x["safe"], none), lambda c: (c != "") & (c != cleaned) & (c != normalized) & fits(c))
        lead = F.when(x["telling"], F.array(cleaned)).otherwise(none)
        generic = F.concat(lead, F.array(normalized), by_head, by_template, safe_ones)
        tidy = F.array_distinct(F.filter(F.transform(generic, T.dedupe_adjacent_words), lambda c: c != ""))
        fixed_ones = F.coalesce(x["fixed"], F.array(x["role"]))
        every = F.when(x["keep_exact"], fixed_ones).otherwise(F.concat(tidy, fixed_ones))
        with_own = F.when((cleaned != "") & ~F.array_contains(every, cleaned), F.concat(F.array(cleaned), every)).otherwise(every)
        return F.slice(F.array_distinct(F.filter(with_own, lambda c: c != "")), 1, limit)

    words = F.filter(F.split("expanded", " "), lambda w: (w != "") & ~w.isin(*T.ROLE_STOPWORDS))
    telling = (F.size(words) > 0) & (F.col("expanded") != F.col("normalized")) & F.exists(words, lambda w: ~w.isin(*T.ROLE_GENERIC_TOKENS))
    exact = F.col("normalized").isin(*lex.families) & (F.col("expanded") == F.col("normalized")) & (F.size(F.array_except("specialty", F.split("normalized", " "))) == 0)
    state = F.struct(
        F.col("expanded").alias("cleaned"), "normalized", "role", "spec", "variants", "has_head", "templates", "safe", "fixed", telling.alias("telling"), exact.alias("keep_exact")
    )
    out = df.select("label", T.let(state, build).alias("v"))
    return T.explode_once(out, ["label"], F.col("v"), "variation", "pos")


def query_class(profiles: DataFrame, lex: RoleLexicon, groups: dict[str, tuple[str, ...]], dense_groups, abstract, business, no_guard=()) -> DataFrame:
    """Family group, density, sparseness and guard flags of each query label.

    ``profiles`` needs title_hints (see :func:`role_hints`) and ``variations`` (array of its family's wordings).
    """
    group = {fam: g for g, fams in groups.items() for fam in fams}
    by_family = F.try_element_at(T.lit_map(group), F.col("role")) if group else F.lit(None).cast("string")
    family_group = F.coalesce(by_family, F.col("role_domain"), F.lit("general"))
    n_words = F.size(F.split("expanded", " "))
    known = F.array_contains(F.coalesce("variations", T.lit_array([])), F.col("expanded")) | F.array_contains(F.transform("title_hints", T.clean_label), F.col("expanded"))
    strict = F.when(F.col("expanded") == F.col("normalized"), True).when(n_words < 2, False).when(F.col("normalized") == "frontend developer", False).otherwise(known)
    guarded = (F.size("specialty") > 0) & (F.col("normalized").isin(*abstract) | (F.col("expanded") != F.col("normalized"))) if abstract else (F.size("specialty") > 0) & (F.col("expanded") != F.col("normalized"))
    needs = F.when(F.coalesce(F.col("domain").isin(*business), F.lit(False)) | F.col("role").isin(*(no_guard or ("",))), False).otherwise(guarded)
    dense = family_group.isin(*dense_groups)
    return profiles.select(
        "label", family_group.alias("family_group"), dense.alias("dense"), F.col("normalized").isin(*(lex.sparse or ("",))).alias("sparse"),
        F.coalesce(F.col("role_domain").isin(*business), F.lit(False)).alias("business"), strict.alias("strict"), needs.alias("needs_specialty"),
    )


def live_floors(sparse: Column, dense: Column, limit: Column) -> dict[str, Column]:
    """Live target, display floor and partial floor of a query."""
    target = F.when(sparse, F.least(limit, F.lit(4))).when(dense, F.least(limit, F.lit(15))).otherwise(F.least(limit, F.lit(12)))
    floor = F.when(sparse, F.least(limit, F.lit(1))).otherwise(F.least(limit, F.lit(10)))
    partial = F.when(sparse, F.least(limit, F.lit(1))).when(dense, F.least(limit, F.greatest(F.lit(4), floor - 2))).otherwise(F.least(limit, F.lit(4)))
    return {"live_target": target, "display_floor": floor, "partial_floor": partial}
