"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap; boosted trees over features of
format and context score them; thresholds calibrated on rows left out of training select
what is redacted. Spans that strict rules find are always kept, the trees add to them.

The trees learn what personal data looks like where the strict rules do not reach. Half of
the training texts, chosen by a hash of their id, have their base spans rewritten into
layouts that the rules miss (an address spelled out, a phone number without its plus, a card
or IP with other separators); what was rewritten is a positive, as are base spans and
assigned secrets left as they were, and every other candidate a negative. No feature tells
whether a rule holds, so context and outer form have to decide.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone", "secret")
#: Tasks that the candidates are dealt to in training, each of which sends its sums to the driver.
PARTS = 64
#: Gradients are summed as whole numbers of 1 / UNIT, scores for thresholds counted in 1 / STEPS.
UNIT, STEPS = 1 << 24, 10_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
#: Precision that a kind's threshold must reach on the rows left out.
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is tried from its first digit only: later starts in it meet the same end
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What every candidate has: a digit, an at sign (also spelled) or an assignment.
_ANY = re.compile(r"[0-9@=:]|[(\[]at[)\]]", re.I)

_TOKEN_AT = re.compile(r"(?<![^\s@])[^\s@]++@[^\s@]++")
# the at sign is looked for first, then the words on either side of it
_AT = re.compile(r" ?[(\[]at[)\]] ?", re.I)
_AFTER_AT = re.compile(r"[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)+", re.I)
_SEPARATED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[(\[]?(?:\.|dot|-|:)[)\]]? ?[0-9]{1,3}){3}(?![0-9])", re.I)
_BROKEN_CARD = re.compile(r"(?<![0-9])[0-9]{3,6}(?:[./_][0-9]{2,6}){2,5}(?![0-9])")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DIGITS = re.compile(r"\+?[0-9][ ().0-9-]*+(?<=[0-9])|\+?[0-9][ ().0-9-]*[0-9]")
_ASSIGN = re.compile(r"(\b\w++)[ \t]?[=:][ \t]?[\"']([^\"'\s]{8,}+)[\"']")
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+")
_SECRET_NAMES = re.compile(r"token|secret|passw|pwd|key|credential|auth", re.I)
_CONTEXTS = tuple(re.compile(p, re.I) for p in (r"token|secret|passw|pwd|key|auth", r"tel|phone|call|mobil", r"card|visa|master|pay", r"mail|contact", r"\bip\b|host|server|addr", r"version|licen[cs]e|v\."))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """What the strict rules find: (start, end, kind), by start, then kind as listed."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if _small_parts(m.group())]
    for m in _CARD.finditer(text):
        digits = _only_digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that might be personal data, with the kind they would be; they may overlap."""
    out, done = set(), 0
    if "@" in text:
        out |= {(m.start(), m.end(), "email") for m in _TOKEN_AT.finditer(text)}
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        after = _AFTER_AT.match(text, m.end())
        if after and start < m.start():
            out.add((start, after.end(), "email"))
        done = m.end()
    # no part of an address is over 255, in whatever layout
    out |= {(m.start(), m.end(), "ip") for p in (_DOTTED, _SEPARATED) for m in p.finditer(text) if _small_parts(".".join(re.findall("[0-9]+", m.group())))}
    for m in [*_DIGITS.finditer(text), *_BROKEN_CARD.finditer(text)]:
        if sum("0" <= c <= "9" for c in m.group()) >= 7:
            out |= {(m.start(), m.end(), "card"), (m.start(), m.end(), "phone")}
    out |= {(m.start(2), m.end(2), "secret") for m in _ASSIGN.finditer(text)}
    out |= {(m.start(), m.end(), "secret") for m in _MIXED.finditer(text)}
    return sorted(out | set(base_spans(text)))


def rewritten(text: str, spans: list[tuple[int, int, str]], salt: int) -> tuple[str, list[tuple[int, int, str]]]:
    """text with each span in a layout that the strict rules miss, and where the spans now
    are. Overlapping later spans stay out. salt picks among layouts."""
    out, found, done, size = [], [], 0, 0
    for k, (start, end, kind) in enumerate(spans):
        if start < done:
            continue
        value, pick = text[start:end], (salt >> (k % 16)) + k
        if kind == "email":
            name, _, domain = value.rpartition("@")
            at, dot = ((" [at] ", "."), ("(at)", "(dot)"), (" (at) ", " [dot] "))[pick % 3]
            value = name + at + domain.replace(".", dot)
        elif kind == "ip":
            value = value.replace(".", (" . ", "[.]", "-")[pick % 3])
        elif kind == "card":
            digits, by = _only_digits(value), "./_"[pick % 3]
            # a last digit alone stays with the group before it
            cuts = list(range(0, len(digits) - 1, 4))
            value = by.join(digits[i:j] for i, j in zip(cuts, [*cuts[1:], len(digits)]))
        elif kind == "phone":
            value = value.replace("+", ("00", "", "00")[pick % 3]).strip()
        out += [text[done:start], value]
        size += start - done
        found.append((size, size + len(value), kind))
        size += len(value)
        done = end
    return "".join([*out, text[done:]]), found


def is_assigned_secret(text: str, start: int, end: int) -> bool:
    """A long value of mixed characters, quoted and assigned to a name like token."""
    before = text[max(0, start - 48) : start]
    value = text[start:end]
    return end - start >= 20 and len(set(value)) >= 8 and before[-1:] in ("'", '"') and bool(re.search(r"(\w+)[ \t]?[=:][ \t]?[\"']$", before)) and bool(_SECRET_NAMES.search(before[-24:]))


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    count = np.bincount(np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8))
    p = count[count > 0] / count.sum()
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    words = max(1, len(s.split()))
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    return [
        *(float(kind == k) for k in KINDS),
        n, digits, digits / n, letters / n, s.count("."), s.count("-") + s.count(" "), s.count("@"), s.count("("), s.count("["), s.count("/") + s.count("_"), words,
        len(groups), min(groups), max(groups), float(-(p * np.log2(p)).sum()), len(set(s)) / n,
        float(s[-1:].isalnum()), float(s[0].isalnum()), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in ("'", '"')),
        float(s[:2] == "00"), float(s[0] == "0"), float(before[-1:] == ""), float(before[-2:-1].isalpha()), float(before[-2:-1] == ":"),
        *(float(bool(c.search(before))) for c in _CONTEXTS),
    ]


class Boosted:
    """Logistic gradient boosting over binned features, in numpy."""

    def __init__(self, cuts, trees, start):
        self.cuts, self.trees, self.start = cuts, trees, start

    @staticmethod
    def _bin(cuts, x):
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, len(cuts)), int)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b = cls._bin(cuts, x)
        return cls.grow(cuts, float(y.sum()), len(y), lambda model, splits: model.histograms(b, y, splits))

    @classmethod
    def grow(cls, cuts, right: float, count: int, histograms) -> Boosted:
        """Trees by histograms(model so far, splits of the tree that grows): for each leaf, feature
        and bin the sums of gradients and of second derivatives, as `histograms` gives them."""
        rate = (right + 1) / (count + 2)
        model = cls(cuts, [], float(np.log(rate / (1 - rate))))
        for _ in range(TREES):
            splits, value = [], []
            for _ in range(DEPTH):
                sums = histograms(model, splits) / UNIT
                splits.append([cls._best(leaf) for leaf in sums])
                # of the last splits, what is left and right of them are the leaves
                value = []
                for leaf, (f, c) in zip(sums, splits[-1]):
                    for side in (leaf[f, : c + 1].sum(0), leaf[f, c + 1 :].sum(0)):
                        value.append(float(RATE * side[0] / (side[1] + 1.0)))
            model.trees.append((splits, value))
        return model

    def histograms(self, b: np.ndarray, y: np.ndarray, splits) -> np.ndarray:
        """Sums by leaf, feature and bin of the binned rows b, in units of 1 / UNIT: whole numbers,
        which give the same sum in any order."""
        p = 1 / (1 + np.exp(-self.raw(b)))
        g, h = np.rint((y - p) * UNIT), np.rint(p * (1 - p) * UNIT)
        node, leaves = self._node(b, splits), 2 ** len(splits)
        out = np.zeros((leaves, b.shape[1], BINS + 1, 2), np.int64)
        for k in range(b.shape[1]):
            at = node * (BINS + 1) + b[:, k]
            for m, weight in enumerate((g, h)):
                out[:, k, :, m] = np.bincount(at, weight, leaves * (BINS + 1)).reshape(leaves, -1)
        return out

    @staticmethod
    def _best(sums: np.ndarray) -> tuple[int, int]:
        """(feature, bin) of the split of a leaf that gains most; rows up to the bin go left."""
        best = (0.0, 0, BINS + 1)
        for k, of in enumerate(sums):
            (g, h), (total_g, total_h) = np.cumsum(of, 0).T, of.sum(0)
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            c = int(np.argmax(gain))
            if gain[c] > best[0] + 1e-9:
                best = (float(gain[c]), k, c)
        return best[1], best[2]

    @staticmethod
    def _node(b: np.ndarray, splits) -> np.ndarray:
        node = np.zeros(len(b), int)
        for level in splits:
            f, c = np.array([s[0] for s in level])[node], np.array([s[1] for s in level])[node]
            node = node * 2 + (b[np.arange(len(b)), f] > c)
        return node

    def raw(self, b: np.ndarray) -> np.ndarray:
        raw = np.full(len(b), self.start)
        for splits, value in self.trees:
            raw += np.array(value)[self._node(b, splits)]
        return raw

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self._bin(self.cuts, x))))

    def dump(self, thresholds: list[float]) -> str:
        return json.dumps({"cuts": [c.tolist() for c in self.cuts], "trees": self.trees, "start": self.start, "thresholds": thresholds})

    @classmethod
    def load(cls, text: str) -> tuple[Boosted, list[float]]:
        d = json.loads(text)
        return cls([np.array(c) for c in d["cuts"]], d["trees"], d["start"]), d["thresholds"]


def fit_model(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> str:
    """Trees from rows with fold > 0; thresholds of each kind from those with fold 0. All
    candidates of a document are to be of one fold."""
    model = Boosted.fit(x[fold > 0], y[fold > 0]) if (fold > 0).any() else Boosted.fit(x, y)
    p, thresholds = model.predict(x[fold == 0]), []
    for k in range(len(KINDS)):
        mine = x[fold == 0][:, k] == 1
        order = np.argsort(-p[mine], kind="stable")
        ranked = np.append(p[mine][order], 0.0)
        right = np.cumsum(y[fold == 0][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        # nothing to calibrate on, or never precise enough: only the strict rules count
        # else half way between the last score that is precise enough and the next
        thresholds.append(max(0.5, float(ranked[good[-1] : good[-1] + 2].mean())) if len(good) else 2.0)
    return model.dump(thresholds)


def _coarse(x: np.ndarray) -> np.ndarray:
    """Numbers to three digits, so that few differ: places where bins may end."""
    with np.errstate(divide="ignore"):
        unit = 10.0 ** (np.floor(np.log10(np.where(x == 0, 1, np.abs(x)))) - 2)
    return np.rint(x / unit) * unit


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """Ends of the bins of each feature: quantiles of all rows, by counts of coarse numbers."""

    def count(batches):
        for batch in batches:
            x = _coarse(np.array(batch.column(0).values).reshape(len(batch), -1))
            for k in range(x.shape[1] if len(batch) else 0):
                v, n = np.unique(x[:, k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(v), pa.array(n, pa.int64())], names=["k", "v", "n"])

    counts = rows.select("x").mapInArrow(count, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most some thousand numbers a feature
    cuts = []
    for _, of in table.sort_values(["k", "v"]).groupby("k"):
        done = of.n.cumsum().to_numpy() / of.n.sum()
        at = np.searchsorted(done, np.linspace(0, 1, BINS + 1)[1:-1])
        cuts.append(np.unique(of.v.to_numpy()[at]))
    return cuts


def fit(docs: DataFrame) -> str | None:
    """The model as JSON, trained on all candidates of all documents; None if there is none.

    Each level of a tree is a pass over the binned candidates: tasks sum gradients by leaf, feature
    and bin, and the driver picks splits from these sums, whose size is fixed."""
    slim = docs.select("doc_id", "text")

    def label(batches):
        for batch in batches:
            fold, rows, good = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if _ANY.search(text):
                    base, salt = base_spans(text), zlib.crc32(str(doc).encode())
                    if salt % 2:
                        text, base = rewritten(text, base, salt >> 1)
                    base = set(base)
                    for s in candidates(text):
                        rows.append(features(text, *s))
                        fold.append(salt // 2 % 5)
                        good.append(int(s in base or s[2] == "secret" and is_assigned_secret(text, s[0], s[1])))
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(good, pa.int32())], names=["fold", "x", "y"])

    every = staged(slim.mapInArrow(label, "fold int, x array<double>, y int"), "pii_candidates")
    # with nothing left after fold 0, that is learned from
    learned = every.where("fold > 0")
    if learned.isEmpty():
        learned = every
    cuts = _cuts(learned)
    if not cuts:
        return None

    def binned(batches):
        for batch in batches:
            if len(batch):
                b = Boosted._bin(cuts, np.array(batch.column(0).values).reshape(len(batch), -1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes()]), pa.array([np.array(batch.column(1)).astype(np.uint8).tobytes()])], names=["b", "y"])

    chunks = staged(learned.select("x", "y").coalesce(PARTS).mapInArrow(binned, "b binary, y binary"), "pii_bins")
    totals = learned.agg(F.sum("y"), F.count("*")).first()

    def histograms(model: Boosted, splits) -> np.ndarray:
        def sums(batches):
            total = 0
            for batch in batches:
                for b, y in zip(*batch.columns):
                    b = np.frombuffer(b.as_py(), np.uint8).reshape(-1, len(cuts))
                    total = total + model.histograms(b.astype(int), np.frombuffer(y.as_py(), np.uint8).astype(float), splits)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

        parts = chunks.mapInArrow(sums, "sums binary").collect()
        return sum(np.frombuffer(r.sums, np.int64) for r in parts).reshape(2 ** len(splits), len(cuts), BINS + 1, 2)

    model = Boosted.grow(cuts, float(totals[0]), totals[1], histograms)

    def scored(batches):
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(0).values).reshape(len(batch), -1)
                kind, at = x[:, : len(KINDS)].argmax(1), np.floor(model.predict(x) * STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), batch.column(1)], names=["kind", "at", "y"])

    scores = every.where("fold = 0").select("x", "y").mapInArrow(scored, "kind int, at int, y int")
    table = scores.groupBy("kind", "at").agg(F.sum("y").alias("good"), F.count("*").alias("n")).toPandas()  # at most STEPS + 1 a kind
    thresholds = []
    for k in range(len(KINDS)):
        mine = table[table.kind == k].sort_values("at", ascending=False)
        good = np.flatnonzero((mine.good.cumsum() / mine.n.cumsum()).to_numpy() >= PRECISION)
        # nothing to calibrate on, or never precise enough: only the strict rules count
        # else half way between the last score that is precise enough and the next
        ranked = np.append(mine["at"].to_numpy(), 0) / STEPS
        thresholds.append(max(0.5, float(ranked[good[-1] : good[-1] + 2].mean())) if len(good) else 2.0)
    return model.dump(thresholds)


def spans(docs: DataFrame, model: str | None) -> DataFrame:
    """Rows (doc_id, base, spans), one per row of docs (doc_id, text): arrays of (start, end,
    kind) in code points, end exclusive, by start, then kind.

    base is what the strict rules find, spans that and what the trees add where no span is
    yet. Null and empty texts have none; repeated rows are separate; other columns are
    ignored.
    """
    slim = docs.select("doc_id", "text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches):
        trees, thresholds = Boosted.load(model) if model else (None, [])
        for batch in batches:
            base, extra, rows = [], [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                base.append(base_spans(text) if _ANY.search(text) else [])
                if trees and _ANY.search(text):
                    for s in set(candidates(text)) - set(base[-1]):
                        rows.append(features(text, *s))
                        extra.append((i, s))
            every = [list(b) for b in base]
            p = trees.predict(np.array(rows)) if rows else ()
            for chance, (i, s) in sorted(zip(p, extra), key=lambda c: (-c[0], c[1])):
                if chance >= thresholds[KINDS.index(s[2])] and all(s[1] <= o[0] or s[0] >= o[1] for o in every[i]):
                    every[i].append(s)
            made = [[[{"start": a, "end": b, "kind": k} for a, b, k in sorted(doc, key=lambda s: (s[0], KINDS.index(s[2])))] for doc in of] for of in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made[0], span), pa.array(made[1], span)], names=["doc_id", "base", "spans"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    arr = "array<struct<start:int,end:int,kind:string>>"
    return slim.mapInArrow(run, f"doc_id {kind}, base {arr}, spans {arr}")


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """text with every span replaced by its kind in angle brackets; overlaps merge."""
    out, done = [], 0
    for start, end, kind in sorted(found):
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]
