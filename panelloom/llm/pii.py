"""Personal data by boosted trees over generated candidates.

``find`` reads each text once. Strict patterns give the base spans (email, ip, card, phone), which
always stay. Generators with high recall propose overlapping spans of the same kinds in looser
forms: written-out or bracketed email signs, letters beyond ASCII in addresses, bracketed dots,
every run of digit groups that could be a card inside a longer run, phone numbers without a plus.
A candidate carries its span and ``CONTEXT`` characters on either side.

``fit`` learns from all distinct candidates. Labels come from the table itself: base spans are 1; so are their rewritings into
loose forms in the same place; base spans with a spoilt check digit, octet, length or domain are
0; so are candidates whose own kind's check fails or whose whole text is a base span of another kind. The kind's check is a feature like the others,
so the trees weigh it against format and context. Gradient boosting with Newton steps on binned
features fits them on three quarters of the candidates (by a digest of the span's text); the rest
calibrates scores by a logistic curve and sets, per kind, the lowest threshold (0.5 or more) from which at
least ``PRECISION`` of the accepted spans of the calibration part are right.

Spark counts equal rows of features once, and adds up the histograms of every tree level, in whole
numbers, so that the order of rows never changes a tree. A level's histogram, a feature's cuts
and the calibration part by kind and margin (leaves are multiples of 1 / ``STEPS``) are all that
reaches the driver, and each is bounded whatever the table's size. ``boost`` is the same fit in memory.

``redactions`` scores all candidates; accepted ones that overlap no base span and no better
accepted span are added. Null and empty texts have no spans; repeated rows get equal answers;
without any base span (an empty table) nothing is added; extra columns are ignored. Only distinct
candidates, their features and the sums are shuffled; memory per task is one Arrow batch.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.store import written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 40
PRECISION = 0.98
TREES, DEPTH, RATE, BINS, PENALTY = 40, 3, 0.2, 32, 1.0
#: Gradients are added up as multiples of 1 / UNIT; leaves are multiples of 1 / STEPS within +-STEEPEST.
UNIT, STEPS, STEEPEST = 1 << 20, 256, 4.0


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# ---------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*")
# A start inside a run of digits reaches the same end as the start of the run, so only the latter is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _small(number: str) -> bool:
    return len(number := number.lstrip("0")) <= 3 and int(number or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern from left to right, found from the @ signs.

    A local part holds no @, so the leftmost match at a sign begins where the run of its letters
    does, but not before the end of the match before.
    """
    at, last = text.find("@"), 0
    while at >= 0:
        start = at - _LOCAL_TAIL.match(text[max(last, at - 64) : at][::-1]).end()
        if at - start == 64:  # a long run: look at all of it
            start = at - _LOCAL_TAIL.match(text[last:at][::-1]).end()
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Strict matches that pass their checks, by start, then kind as listed."""
    out = [Span(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(Span(*m.span(), "ip"))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(Span(*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(Span(*m.span(), "phone"))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# ---------------------------------------------------------------- generators

_SIGN = re.compile(r"@|[\[({] ?at ?[\])}]", re.I)
_WIDE_LOCAL = re.compile(r"[\w.%+-]+ ?\Z")
_WIDE_DOMAIN = re.compile(r" ?[\w-]{1,63}(?: ?(?:\.|[\[({] ?(?:\.|dot) ?[\])}]) ?[\w-]{1,63}){1,8}", re.I)
_WIDE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:[.,]|[\[({] ?(?:\.|dot) ?[\])}]) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_GROUPS = re.compile(r"[0-9]++(?:[ .-][0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_WIDE_PHONE = re.compile(r"(?:\+ ?|\()?[0-9](?:[ ().\-/]{0,2}[0-9]){8,16}")


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all kinds, base spans included. Each generator is linear in the text."""
    out = set(base_spans(text))
    for m in _SIGN.finditer(text):
        head = max(0, m.start() - 65)
        if (a := _WIDE_LOCAL.search(text[head : m.start()])) and (b := _WIDE_DOMAIN.match(text, m.end())):
            out.add(Span(head + a.start(), b.end(), "email"))
    for m in _WIDE_IP.finditer(text):
        out.add(Span(*m.span(), "ip"))
    for run in _GROUPS.finditer(text):
        if run.end() - run.start() < 8:
            continue
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run[0])]
        for i, (start, _) in enumerate(groups):
            size = 0
            for a, b in groups[i:]:
                size += b - a
                if size > 19:
                    break
                if size >= 13:
                    out.add(Span(start, b, "card"))
    for m in _WIDE_PHONE.finditer(text):
        out.add(Span(*m.span(), "phone"))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# ---------------------------------------------------------------- features

# Words near a number or address that speak for or against a kind; fixed values, lower case.
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "whatsapp"),
    "against": ("version", "order", "invoice", "isbn", "page", "id", "section", "serial", "price", "token", "key"),
}
NAMES = (
    *(f"is_{k}" for k in KINDS), "characters", "digits", "separators", "groups", "longest_group", "shortest_group", "check", "plus", "brackets", "letters",
    "beyond_ascii", "different_digits", "digit_before", "digit_after", "letter_before", "letter_after", "sign_before", "sign_after", "digits_left", "digits_right",
    "upper_left", *(f"cue_{k}" for k in CUES),
)


def passes(kind: str, span: str) -> bool:
    """The kind's own check on a loose form."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return len(parts := _GROUP.findall(span)) == 4 and all(map(_small, parts))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    domain = re.split(r"\.|dot", span.lower())
    return len(domain) > 1 and domain[-1].strip(" ])}").isalpha() and len(domain[-1].strip(" ])}")) > 1


def features(kind: str, left: str, span: str, right: str) -> list[float]:
    groups = [len(g) for g in _GROUP.findall(span)]
    digits = sum(groups)
    before, after = left[-1:], right[:1]
    near = f"{left} {right[:12]}".lower()
    is_digit = lambda c: "0" <= c <= "9"
    return [
        *(float(kind == k) for k in KINDS), len(span), digits, len(span) - digits, len(groups), max(groups, default=0), min(groups, default=0),
        passes(kind, span), "+" in span, sum(map(span.count, "()[]{}")), sum(map(str.isalpha, span)), not span.isascii(),
        len(set(span) & set("0123456789")), is_digit(before), is_digit(after), before.isalpha(), after.isalpha(),
        bool(before) and before in ".,:-_/=#+@$", bool(after) and after in "-_/=#+@%$" or bool(re.match(r"[.,][0-9]", right)),
        sum(map(is_digit, left)), sum(map(is_digit, right)), sum(map(str.isupper, left)), *(float(any(w in near for w in CUES[c])) for c in CUES),
    ]


# ---------------------------------------------------------------- labels


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(parts).encode("utf-8", "surrogatepass")).digest()[:8], "big")


def _cut(digits: str, sizes: Sequence[int], by: str) -> str:
    out, at = [], 0
    for s in sizes:
        out.append(digits[at : at + s])
        at += s
    return by.join([*filter(None, out), *filter(None, [digits[at:]])])


def rewritings(kind: str, left: str, span: str, right: str) -> list[tuple[str, str, str, str]]:
    """The same datum in a loose form, in the same place; the digest of the span picks among the forms."""
    pick = _digest(kind, span)
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        at, dot = (("@", " [dot] "), (" (at) ", "."), (" [at] ", " [dot] "), (" {at} ", " (dot) "))[pick % 4]
        return [(kind, left, span.replace("@", at).replace(".", dot) if dot != "." else span.replace("@", at), right), (kind, left, "é" + span, right)]
    if kind == "ip":
        return [(kind, left, span.replace(".", ("[.]", " . ", "(.)", " [dot] ")[pick % 4]), right), (kind, left, span, ":8080" + right)]
    if kind == "card":
        return [(kind, left, _cut(digits, (4, 4, 4, 4), " .-"[pick % 3]), right), (kind, left, span, f" {span}{right}"[:CONTEXT]), (kind, f"{left}{span} "[-CONTEXT:], span, right)]
    forms = (digits, _cut(digits, (len(digits) - 10, 3, 3), "-"), f"{_cut(digits[-10:], (3, 3), '.')}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}")
    return [(kind, left, forms[pick % 4], right), (kind, left, forms[(pick + 1) % 4], right)]


def spoilt(kind: str, left: str, span: str, right: str) -> list[tuple[str, str, str, str]]:
    """What looks like the datum and is none."""
    pick = _digest(span, kind)
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        return [(kind, left, span.split(".")[0].replace("@", " @ ") + ".5", right), (kind, left, f"{pick % 90 + 10}@{pick % 7}.{pick % 10}", right)]
    if kind == "ip":
        return [(kind, left, re.sub(r"[0-9]+", str(256 + pick % 700), span, count=1), right), (kind, left, span, f".{pick % 40}{right}"), (kind, left + "version ", span, right)]
    if kind == "card":
        other = str((int(digits[-1]) + 1 + pick % 9) % 10)
        wrong = span[:-1] + other
        return [(kind, left, wrong, right), (kind, left, _cut(digits[:-1] + other, (4, 4, 4, 4), " .-"[pick % 3]), right), (kind, f"{left}{pick % 1000}", span, right), (kind, left, span, f"{pick % 1000}{right}")]
    number = str(pick)
    return [(kind, left, number[:9], right), (kind, left, number[:16], right), (kind, left + "order ", number[:12], right), (kind, left, f"{number[:3]}.{number[3:6]}.{number[6:12]}", f".{number[12:14]}{right}")]


def labelled(rows: Sequence[tuple[str, str, str, str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and whether a row calibrates, from (kind, left, span, right, base) rows."""
    x, y, calibrates = [], [], []

    def add(case: tuple[str, str, str, str], label: int, part: bool) -> None:
        x.append(features(*case))
        y.append(label)
        calibrates.append(part)

    for *case, base in rows:
        kind, left, span, right = case
        part = _digest(_NOT_DIGIT.sub("", span) or span) % 4 == 0
        if base:
            add(case, 1, part)
            for c in rewritings(*case):
                add(c, 1, part)
            for c in spoilt(*case):
                add(c, 0, part)
        elif not passes(kind, span) or any(s.kind != kind and s.end - s.start == len(span) for s in base_spans(span)):
            add(case, 0, part)
    return np.array(x, np.float64).reshape(-1, len(NAMES)), np.array(y, np.float64), np.array(calibrates, bool)


# ---------------------------------------------------------------- boosted trees


class Model(NamedTuple):
    """Complete binary trees by level: feature and cut of each inner node, value of each leaf; a logistic curve; thresholds."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    slope: float
    shift: float
    thresholds: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -50, 50)))


class Growing(NamedTuple):
    """Trees by bins: a row goes right where its bin of the feature is above the limit; the last tree may still lack levels and has no leaves."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def node(self, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, self.feature[tree][at]] > self.limit[tree][at])
        return at - (2**levels - 1)

    def histogram(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray, level: int) -> np.ndarray:
        """Sums of gradients and of curvatures by node of the level, feature and bin; row k counts n[k] times."""
        margin = np.full(len(bins), self.base)
        for tree in range(len(self.value)):
            margin += self.value[tree][self.node(tree, bins, DEPTH)]
        p = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        weights = [np.rint(w * UNIT) * n for w in (y - p, p * (1 - p))]
        first = self.node(len(self.value), bins, level) * bins.shape[1] * (BINS + 1)
        size = 2**level * bins.shape[1] * (BINS + 1)
        out = np.zeros((2, size), np.int64)
        for f in range(bins.shape[1]):
            place = first + f * (BINS + 1) + bins[:, f]
            for k, w in enumerate(weights):  # whole numbers below 2 ** 53: exact in any order
                out[k] += np.bincount(place, weights=w, minlength=size).astype(np.int64)
        return out


def _split(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and limit of each node of a level and the sums of its two sides; a node without a gain sends all rows left."""
    width, nodes = sums.shape[1], np.arange(sums.shape[1])
    feature, limit, best = np.zeros(width, np.int64), np.full(width, BINS), np.full(width, 1e-9)
    whole = sums[:, :, 0].sum(2)
    sides = np.stack([whole, np.zeros_like(whole)])
    part = lambda v: v[0] * v[0] / (v[1] + PENALTY)
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        left = sums[:, :, f].cumsum(2)[:, :, : len(at)]
        right = whole[:, :, None] - left
        gain = part(left) + part(right) - part(whole)[:, None]
        k = gain.argmax(1)
        better = gain[nodes, k] > best
        best[better] = gain[nodes, k][better]
        feature[better], limit[better] = f, k[better]
        sides[0][:, better], sides[1][:, better] = left[:, nodes, k][:, better], right[:, nodes, k][:, better]
    return feature, limit, sides


def _grid(value: np.ndarray | float) -> np.ndarray:
    return np.rint(np.asarray(value) * STEPS) / STEPS


def grow(cuts: list[np.ndarray], share: float, histogram: Callable[[Growing, int], np.ndarray]) -> Model:
    """TREES trees of DEPTH levels; ``histogram`` adds up one level over all rows, of which ``share`` have label 1."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    g = Growing(float(_grid(np.log(share / (1 - share)))), np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)))
    for _ in range(TREES):
        g = g._replace(feature=np.vstack([g.feature, np.zeros((1, inner), np.int64)]), limit=np.vstack([g.limit, np.full((1, inner), BINS)]))
        for level in range(DEPTH):
            sums = histogram(g, level).reshape(2, 2**level, len(cuts), BINS + 1) / UNIT
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            g.feature[-1][nodes], g.limit[-1][nodes], sides = _split(sums, cuts)
        gradient, curvature = (sides[:, k].T.ravel() for k in (0, 1))  # leaves from left to right
        value = _grid(np.clip(RATE * gradient / (curvature + PENALTY), -STEEPEST, STEEPEST))
        g = g._replace(value=np.vstack([g.value, value]))
    cut = np.array([[cuts[f][k] if k < BINS else np.inf for f, k in zip(*tree)] for tree in zip(g.feature, g.limit)])
    return Model(g.feature, cut, g.value, g.base, 1.0, 0.0, {})


def calibrated(model: Model, kinds: np.ndarray, m: np.ndarray, right: np.ndarray, n: np.ndarray) -> Model:
    """The model with curve and thresholds, from numbers of rows and of right ones by kind and margin."""
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton steps, with a weak pull to the uncalibrated curve
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -50, 50)))
        g = np.array([(m * (right - n * p)).sum() - (slope - 1), (right - n * p).sum() - shift])
        w = n * p * (1 - p)
        h = np.array([[(m * m * w).sum() + 1, (m * w).sum()], [(m * w).sum(), w.sum() + 1]])
        slope, shift = np.array([slope, shift]) + np.linalg.solve(h, g)
    model = model._replace(slope=float(slope), shift=float(shift))
    p, thresholds = 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -50, 50))), {}
    for k in KINDS:
        of = kinds == k
        order = np.argsort(-p[of], kind="stable")
        score = p[of][order]
        # Equal scores are accepted together, so a threshold lies only where the score changes.
        ends = np.append(score[1:] != score[:-1], True)[: len(score)]
        good = ends & (right[of][order].cumsum() / n[of][order].cumsum() >= PRECISION) & (score >= 0.5)
        if good.any():
            # Half way between the last accepted score and the next lower one, so that unseen spans near the accepted ones are taken.
            last = int(np.flatnonzero(good)[-1])
            lower = score[last + 1] if last + 1 < len(score) else 0.0
            thresholds[k] = max(0.5, float(score[last] + lower) / 2)
    return model._replace(thresholds=thresholds)


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A value's bin counts the cuts below it, so "bin > k" says "value > cut k"."""
    return np.column_stack([np.searchsorted(c, col) for c, col in zip(cuts, x.T)]).astype(np.uint8)


def boost(x: np.ndarray, y: np.ndarray, calibrates: np.ndarray, kinds: np.ndarray) -> Model | None:
    """Trees on the rows that do not calibrate, curve and thresholds on those that do; None without both labels in both parts."""
    if any(len(set(y[part])) < 2 for part in (calibrates, ~calibrates)):
        return None
    fit_x, fit_y = x[~calibrates], y[~calibrates]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in fit_x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, fit_x.T)]
    bins, once = _binned(fit_x, cuts), np.ones(len(fit_y))
    model = grow(cuts, fit_y.sum() / len(fit_y), lambda g, level: g.histogram(bins, fit_y, once, level))
    rows = pd.DataFrame({"kind": kinds[calibrates], "margin": model.margin(x[calibrates]), "right": y[calibrates]})
    sums = rows.groupby(["kind", "margin"], as_index=False)["right"].agg(["sum", "count"]).sort_values(["kind", "margin"])
    return calibrated(model, *(sums[c].to_numpy() for c in ("kind", "margin", "sum", "count")))


# ---------------------------------------------------------------- jobs

CASE = "kind:string,start:long,end:long,base:boolean,left:string,span:string,right:string"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, candidates with their context."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                t = t or ""
                base = set(base_spans(t))
                rows.append([
                    (s.kind, s.start, s.end, s in base, t[max(0, s.start - CONTEXT) : s.start], t[s.start : s.end], t[s.end : s.end + CONTEXT]) for s in candidates(t)
                ])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "candidates": pd.Series(rows, dtype=object)})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(of_batches, f"doc_id long, candidates array<struct<{CASE}>>")


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, len(NAMES))


def feature_rows(cases: DataFrame) -> DataFrame:
    """Distinct labelled rows of features (as little-endian 32-bit numbers) of all candidates, with the times each comes up."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y, calibrates = labelled(list(batch.itertuples(index=False, name=None)))
            yield pd.DataFrame({"x": [r.tobytes() for r in x.astype("<i4")], "y": y.astype(int), "calibrates": calibrates})

    rows = cases.select("kind", "left", "span", "right", "base").mapInPandas(of_batches, "x binary, y int, calibrates boolean")
    return rows.groupBy("x", "y", "calibrates").agg(F.count(F.lit(1)).alias("n"))


def cut_values(rows: DataFrame) -> list[np.ndarray]:
    """Per feature its values at BINS - 1 evenly spaced ranks of all rows, without the highest value."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch.column("x"), "<i4"), batch.column("n").to_numpy()
            for f, column in enumerate(x.T):
                values, at = np.unique(column, return_inverse=True)
                sums = np.bincount(at, weights=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(sums)], names=["feature", "value", "n"])

    counts = rows.select("x", "n").mapInArrow(of_batches, "feature int, value int, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("feature")  # one row per distinct value of a feature: lengths and numbers within a span
    counts = counts.withColumn("all", F.sum("n").over(of)).withColumn("highest", F.max("value").over(of)).withColumn("upto", F.sum("n").over(of.orderBy("value")))
    ranks = lambda upto: f"least({BINS - 1}, ({BINS} * ({upto}) - 1) div (all - 1))"  # noqa: E731  # ranks k (all - 1) / BINS below ``upto``
    found = counts.where("value < highest").where(f"{ranks('upto')} > if(upto = n, 0, {ranks('upto - n')})").select("feature", "value").collect()
    return [np.array(sorted(r["value"] for r in found if r["feature"] == f), np.float64) for f in range(len(NAMES))]


def binned_rows(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Distinct rows of bins (a byte for each feature), with the times each comes up."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = pa.array([r.tobytes() for r in _binned(_matrix(batch.column("x"), "<i4"), cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([bins, batch.column("y"), batch.column("n")], names=["bins", "y", "n"])

    return rows.select("x", "y", "n").mapInArrow(of_batches, "bins binary, y int, n long").groupBy("bins", "y").agg(F.sum("n").alias("n"))


def level_sums(binned: DataFrame, growing: Growing, level: int) -> np.ndarray:
    """One level's histogram over all rows: a sum per task, added up by Spark."""
    shape = (2, 2**level * len(NAMES) * (BINS + 1))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            total += growing.histogram(_matrix(batch.column("bins"), "u1"), batch.column("y").to_numpy(), batch.column("n").to_numpy(), level)
        place = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (place, *total[:, place])], names=["place", "g", "h"])

    sums = binned.mapInArrow(of_batches, "place long, g long, h long").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros(shape, np.int64)
    out[:, sums["place"].to_numpy()] = sums["g"].to_numpy(), sums["h"].to_numpy()
    return out


def by_margin(rows: DataFrame, model: Model) -> pd.DataFrame:
    """Numbers of rows (count) and of those with label 1 (sum) by kind and margin, in order."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), "<i4")
            columns = [x[:, : len(KINDS)].argmax(1), np.rint(model.margin(x) * STEPS).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("y"), batch.column("n")], names=["kind", "steps", "y", "n"])

    found = rows.select("x", "y", "n").mapInArrow(of_batches, "kind long, steps long, y int, n long").groupBy("kind", "steps")
    sums = found.agg(F.sum(F.col("y") * F.col("n")).alias("sum"), F.sum("n").alias("count")).toPandas()
    sums = sums.assign(kind=np.array(KINDS)[sums["kind"].to_numpy(np.int64)], margin=sums["steps"] / STEPS)
    return sums.sort_values(["kind", "margin"])


def fit(found: DataFrame) -> Model | None:
    """The model, from all distinct candidates; None without both labels in both parts."""
    cases = found.select(F.inline("candidates")).select("kind", "left", "span", "right", "base").distinct()
    rows = written(feature_rows(cases), "feature-rows")
    sizes = {(r["calibrates"], r["y"]): r["n"] for r in rows.groupBy("calibrates", "y").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < 4:
        return None
    fits = rows.where(~F.col("calibrates"))
    cuts = cut_values(fits)
    binned = written(binned_rows(fits, cuts), "binned-rows")
    model = grow(cuts, sizes[False, 1] / (sizes[False, 0] + sizes[False, 1]), lambda g, level: level_sums(binned, g, level))
    sums = by_margin(rows.where("calibrates"), model)
    return calibrated(model, *(sums[c].to_numpy() for c in ("kind", "margin", "sum", "count")))


def chosen(spans: list[tuple[float, Span]], base: list[Span]) -> list[Span]:
    """Base spans and, best first, accepted spans that overlap nothing kept so far."""
    taken: list[tuple[int, int]] = []  # apart from each other, by start
    for s in sorted(base):
        if taken and s.start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], s.end))
        else:
            taken.append((s.start, s.end))
    kept = list(base)
    for _, s in sorted(spans, key=lambda c: (-c[0], c[1].start, KINDS.index(c[1].kind), -c[1].end)):
        k = bisect.bisect_left(taken, (s.end, 0))  # the first that begins at or behind the end
        if not k or taken[k - 1][1] <= s.start:
            taken.insert(k, (s.start, s.end))
            kept.append(s)
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redactions(found: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [list(c) for c in batch["candidates"]]
            loose = [(k, c) for k, cases in enumerate(lists) for c in cases if not c["base"] and model and c["kind"] in model.thresholds]
            scores = model.probability(np.array([features(c["kind"], c["left"], c["span"], c["right"]) for _, c in loose])) if loose else ()
            accepted: dict[int, list[tuple[float, Span]]] = {}
            for (k, c), p in zip(loose, scores):
                if p >= model.thresholds[c["kind"]]:
                    accepted.setdefault(k, []).append((float(p), Span(c["start"], c["end"], c["kind"])))
            rows = []
            for k, cases in enumerate(lists):
                base = [Span(c["start"], c["end"], c["kind"]) for c in cases if c["base"]]
                counts = [sum(s.kind == kind for s in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(chosen(accepted.get(k, []), base))))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.mapInPandas(of_batches, f"doc_id long, {counts}, base_sha256 string, spans string")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    found = written(find(docs, doc_id, text), "candidates")
    return redactions(found, fit(found))


def redacted(text: str, spans: str) -> str:
    """The text with each of its spans (as joined in the result) replaced by its kind in brackets; the widest of overlapping ones."""
    out, last = [], 0
    parts = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    for a, b, kind in parts:
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
            last = -b
        elif -b > last:  # overlaps the one before and reaches further
            last = -b
    return "".join([*out, text[last:]])
