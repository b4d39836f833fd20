"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier is trained on the result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from docmarket.llm.words import flat, slices
from docmarket.session import cut_lineage

BASE = ("email", "ip", "card", "phone")
LIKELY = tuple(f"likely_{k}" for k in BASE)
STATE = "base array<struct<kind:int,start:bigint,end:bigint>>, candidates array<struct<kind:int,start:bigint,end:bigint,votes:int,features:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# From the start of a digit run only: a match that fails there fails at its later digits too.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Where a spelled-out address has its "at"; what stands before it is at most 65 characters long.
_SPELLED_AT = re.compile(r"(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,10}")
_BEFORE_AT = 65
# Wider shapes, which the labelers judge.
_WIDE = (
    re.compile(r"[A-Za-z0-9._-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,10}"),
    re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    _CARD,
    # Its first character leads, as a search skips to that one only then; what may not stand before it is looked at next.
    re.compile(r"[0-9(](?<![0-9+][0-9(])(?:(?<=\()[0-9]{2,4}|(?<=[0-9])[0-9]{1,3})\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5})?(?![0-9])"),
)


@dataclass(frozen=True)
class Gazetteer:
    """Short lists that labelers look things up in; all lower case."""

    suffixes: frozenset = frozenset("com org net edu gov info biz io co uk de fr es it nl ch at eu us ca".split())
    issuers: tuple = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")  # first digits of card issuers
    near: tuple = (
        ("mail", "contact", "write", "@", "correo", "courriel"), ("ip", "host", "server", "address", "addr"),
        ("card", "visa", "credit", "carte", "tarjeta", "karte", "payment"), ("phone", "tel", "call", "fax", "mobile", "ruf", "móvil"),
    )
    far: tuple = ("isbn", "issn", "order", "invoice", "version", "total", "page", "nr.", "id", "serial", "figure", "$", "%")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            out.append((0, start, done))
        at = text.find("@", done if match else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def labelers(kind: int, value: str, before: str, after: str, lists: Gazetteer) -> list[int]:
    """Votes of the labelers on one candidate: 1 personal, -1 not, 0 no opinion."""
    digits = _digits(value)
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", value) if g]
    # Regular expressions and checks on the string alone.
    shape = {
        0: 1 if re.search(r"\((?:at|dot)\)|\[(?:at|dot)\]", value) else 0, 1: 1 if len({*value.replace(":", "")}) > 3 else -1,
        2: (1 if luhn(digits) else -1) if 13 <= len(digits) <= 19 else -1, 3: 1 if 9 <= len(digits) <= 12 else -1,
    }[kind]
    grouped = {0: 0, 1: 0, 2: 1 if [len(g) for g in groups] == [4] * 4 else 0, 3: 1 if re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", value) else 0}[kind]
    same = -1 if len({*digits}) < 3 and kind > 1 else 0
    # Gazetteers.
    known = {
        0: 1 if groups and groups[-1].lower() in lists.suffixes else -1, 1: 0,
        2: 1 if len(digits) >= 13 and digits.startswith(lists.issuers) else 0, 3: 0,
    }[kind]
    # Context.
    near = 1 if any(w in before for w in lists.near[kind]) else 0
    far = -1 if any(w in before for w in lists.far) or after[:1] in ("%", "€") else 0
    return [shape, grouped, same, known, near, far]


LABELERS = 6


def features(kind: int, value: str, before: str, after: str) -> int:
    """Bits the span classifier sees: the string's form and its neighbours, not the votes."""
    digits = sum("0" <= c <= "9" for c in value)
    bits = (
        digits >= 13, digits >= 9, len(value) > 19, len({*value}) < 6, " " in value, "-" in value, "." in value, "(" in value or "[" in value, value[:1] == "0",
        before[-1:].isalnum(), after[:1].isalnum(), any(c.isdigit() for c in before[-12:]), bool(re.search(r"[a-z]{3,}\W{1,3}$", before)), ":" in before[-3:] or "=" in before[-3:],
    )
    return sum(int(b) << i for i, b in enumerate(bits))


FEATURES = 14


def wide_matches(kind: int, text: str) -> Iterator[re.Match]:
    """Matches of a wider shape, from left to right; texts and places that lack what the shape needs are passed over."""
    pattern = _WIDE[kind]
    if kind == 1 and text.count(":") < 7:
        return
    if kind != 0:
        yield from pattern.finditer(text)
        return
    done, sign = 0, _SPELLED_AT.search(text)
    while sign:
        match = next(filter(None, (pattern.match(text, at) for at in range(max(done, sign.start() - _BEFORE_AT), sign.start()))), None)
        if match:
            done = match.end()
            yield match
        sign = _SPELLED_AT.search(text, done if match else sign.start() + 1)


def find_candidates(text: str, base: list[tuple[int, int, int]], lists: Gazetteer, context: int = 40) -> list[dict]:
    """Candidates with votes and features. Base spans are candidates too: labelers and classifier learn from them."""
    spans = {(k, a, b): 1 for k, a, b in base}
    taken = sorted((a, b) for _, a, b in base)
    for kind in range(len(_WIDE)):
        for m in wide_matches(kind, text):
            a, b = m.span()
            if (kind == 2 and not 13 <= len(_digits(m[0])) <= 19) or any(x < b and a < y for x, y in taken):
                continue
            spans[kind, a, b] = 0
    out = []
    for (kind, a, b), fixed in sorted(spans.items()):
        before, after = text[max(0, a - context) : a].lower(), text[b : b + context].lower()
        votes = labelers(kind, text[a:b], before, after, lists)
        if fixed and kind in (0, 1, 3):
            votes[0] = 1
        code = sum((v + 1) * 3**i for i, v in enumerate(votes))
        out.append({"kind": kind, "start": a, "end": b, "votes": code, "features": features(kind, text[a:b], before, after)})
    return out


def read_candidates(docs: DataFrame, lists: Gazetteer, text: str) -> DataFrame:
    """The rows of ``docs`` without the text, with base spans and candidates (positions in characters)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "base", "candidates", "added")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = pa.int64()
        span = pa.struct([("kind", pa.int32()), ("start", long), ("end", long)])
        candidate = pa.struct([*span, ("votes", pa.int32()), ("features", pa.int32())])
        signs = np.zeros(256, dtype=bool)
        signs[[*range(48, 58), 64, 91]] = True  # a digit, @ or [
        for batch in batches:
            base, found = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for a, b in slices(batch[text]):
                part = batch[text].slice(a, b - a)
                raw, ends = flat(part)
                at = [np.flatnonzero(signs[raw]), np.array([m.start() for m in re.finditer(rb" at |\(at\)", raw.tobytes())], dtype=np.int64)]
                for r in np.unique(np.searchsorted(ends, np.concatenate(at), side="right") - 1).tolist():
                    value = part[r].as_py()
                    own = base_spans(value)
                    base[a + r] = [{"kind": k, "start": x, "end": y} for k, x, y in own]
                    found[a + r] = find_candidates(value, own, lists)
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(candidate))], [*names, "base", "candidates"])

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [STATE]))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability of "personal" for each vote pattern, and each labeler's reliability (share of right votes).

    Labelers are taken as independent given the truth: vote v has probability p(v | truth). Starts from
    the majority; one count is added everywhere, so no probability is 0.
    """
    post = np.clip(0.5 + 0.25 * votes.sum(axis=1), 0.05, 0.95)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        table = np.einsum("tp,plv->tlv", weight, one_hot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1.0) / (weight.sum() + 2.0)
        log = np.log(prior)[:, None] + np.einsum("plv,tlv->tp", one_hot, np.log(table))
        new = 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    right = (weight[0] @ (votes < 0) + weight[1] @ (votes > 0)) / np.maximum((counts @ (votes != 0)), 1e-9)
    return post, right


def train_classifier(bits: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = 50, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps on feature patterns with soft labels: bias first, then one weight per bit."""
    x = np.column_stack((np.ones(len(bits)), (bits[:, None] >> np.arange(FEATURES)) & 1)).astype(float)
    w = np.zeros(FEATURES + 1)
    keep = np.diag(np.r_[1e-3, np.full(FEATURES, penalty)])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (total * p * (1 - p))[:, None]) + keep, x.T @ (positive - total * p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(candidates: DataFrame) -> dict[int, np.ndarray]:
    """Classifier weights per kind. Only counts by pattern reach the driver: at most 3**6 vote patterns and 2**14 feature patterns a kind."""
    each = candidates.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    patterns = each.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    posts = []
    for kind in range(len(BASE)):
        own = [r for r in patterns if r["kind"] == kind]
        if own:
            votes = np.array([[r["votes"] // 3**i % 3 - 1 for i in range(LABELERS)] for r in own])
            post, _ = expectation_maximisation(votes, np.array([r["count"] for r in own], float))
            posts += [(kind, r["votes"], float(p)) for r, p in zip(own, post)]
    if not posts:
        return {}
    labelled = each.join(each.sparkSession.createDataFrame(posts, "kind int, votes int, post double"), ["kind", "votes"])
    rows = labelled.groupBy("kind", "features").agg(F.sum("post").alias("positive"), F.count(F.lit(1)).alias("total")).orderBy("kind", "features").collect()
    out = {}
    for kind in {r["kind"] for r in rows}:
        own = [r for r in rows if r["kind"] == kind]
        out[kind] = train_classifier(*(np.array([r[c] for r in own], t) for c, t in (("features", np.int64), ("positive", float), ("total", float))))
    return out


def find_personal_data(docs: DataFrame, lists: Gazetteer = Gazetteer(), threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the text, with ``base`` and ``added`` spans (kind, start, end; characters, end exclusive).

    base are the fixed patterns. Wider candidates are voted on by regular expressions, gazetteers and
    context labelers; expectation-maximisation over the vote patterns of the whole corpus gives every
    labeler's reliability and every pattern's probability; a logistic classifier over the form of a span
    is trained on these as soft labels and adds candidates of at least ``threshold`` that overlap no base span.

    The text is read once; only spans are kept for the second step. Nulls: a null text has none.
    Repeated rows are read each. Empty tables give no rows. Long texts are read whole. Other columns are passed on;
    those called ``base``, ``added`` or ``candidates`` give way to the operator's own.
    """
    rows = cut_lineage(read_candidates(docs, lists, text))
    weights = train(rows)
    table = F.array(*[F.array(*[F.lit(float(w)) for w in weights.get(k, np.r_[-99.0, np.zeros(FEATURES)])]) for k in range(len(BASE))])

    def score(c: Column) -> Column:
        own = F.get(table, c["kind"])
        bits = sum((F.get(own, F.lit(i + 1)) * F.shiftright(c["features"], i).bitwiseAND(1) for i in range(FEATURES)), F.get(own, F.lit(0)))
        return bits

    limit = float(np.log(threshold / (1 - threshold)))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter("candidates", lambda c: free(c) & (score(c) >= limit))
    named = lambda spans, names: F.transform(spans, lambda s: F.struct(F.get(F.array(*[F.lit(n) for n in names]), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn("added", named(added, LIKELY)).withColumn("base", named(F.col("base"), BASE)).drop("candidates")
