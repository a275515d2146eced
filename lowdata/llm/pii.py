"""Personal data: fixed patterns plus a skip-chain conditional random field.

The patterns (e-mail, IP, payment card, phone) give the base spans.  The
field decides about the further *mentions* of a document - number groups of six or more
digits and tokens with ``@`` that no pattern accepted.  Its nodes are all mentions and
base spans in text order; base spans are observed.  Potentials: the features of a
mention; the labels of two neighbours in the text (chain: a full matrix, learned); agreement of distant
nodes that repeat or resemble each other - same last seven digits, same first three parts
of a dotted number, or same user and host (skip).  A skip edge from a base span carries its kind, with a learned
weight a kind; one between two mentions only says that they are alike, with one weight for all labels, so
repetition alone is no evidence for any kind.  Weights are learned by
pseudo-likelihood from a bounded sample of texts, labelled by the base spans.  Each
base span also teaches by its shortened form (a phone without country code, a card or
IP without its first or last group, an address without its domain's end): linked to the
full form it has that kind; alone, or repeated alone, it has none.  So a short form counts as personal data
where the document holds the long one.  Marginals come from loopy sum-product
message passing over the whole document, until the messages settle; the bound on rounds grows
with the longest path of links.  Occurrences that share a key are linked one to the next, and each
mention to the nearest base span of its key before it, or else the first after it, so that a full form reaches
every repeat directly; a token repeated thousands of times has a linear number of links.

Edge cases: null and empty texts have no spans; spans are in code points, end
exclusive; all scans are linear in the text, so very long texts and tokens are safe;
repeated rows give repeated results; without mentions in the sample the field adds
nothing; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import by_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERS = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20().-]{1,3}[0-9]++)*+")
NOT_DIGIT = re.compile(r"[^0-9]+")
MAX_TRAIN, NEAR, ROUNDS = 3000, 60, 12

Span = tuple[int, int, int]  # kind (index into KINDS), start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four patterns, leftmost and non-overlapping per kind; ordered by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            s = at
            while s > done and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                done = m.end()
                out.append((0, s, done))
        at = text.find("@", max(at + 1, done))
    for m in DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") >= 3:
            parts, s = chain.split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                e = s + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    out.append((1, s, e))
                s = e + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = NOT_DIGIT.sub("", m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(label or -1, start, end) in text order: base spans, then what else may be personal data between them."""
    taken = sorted((s, e, k) for k, s, e in base)
    out, pos = [], 0
    for s, e, k in [*taken, (len(text), len(text), -1)]:
        if s > pos:
            for m in NUMBERS.finditer(text, pos, s):
                a, b = m.span()
                digits = sum(map(str.isdigit, m.group()))
                if digits >= 6 and not (a and text[a - 1].isalnum()) and not text[b:b + 1].isalnum():
                    out.append((-1, a, b))
            at = text.find("@", pos, s)
            while at >= 0:
                a, b = at, at + 1
                while a > pos and not text[a - 1].isspace():
                    a -= 1
                while b < s and not text[b].isspace():
                    b += 1
                if b - a > 2:
                    out.append((-1, a, b))
                pos = b
                at = text.find("@", b, s)
        if k >= 0:
            out.append((k + 1, s, e))
        pos = max(pos, e)
    return sorted(out, key=lambda x: (x[1], x[2]))


DIGIT_STEPS = (7, 8, 10, 11, 12, 16, 17, 20)


def features(text: str) -> list[float]:
    """Shape of one mention."""
    digits = NOT_DIGIT.sub("", text)
    n = len(digits)
    parts = [p.lstrip("0") for p in text.split(".")]
    dotted = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    step = sum(n >= s for s in DIGIT_STEPS)
    return [1.0, *(float(step == k) for k in range(len(DIGIT_STEPS) + 1)), float(text.startswith("+")), float("(" in text),
            float("." in text), float(" " in text or "-" in text), float(n >= 12 and luhn(digits)), float(dotted),
            float("@" in text), float("@" in text and "." in text.split("@")[-1])]


def key(text: str) -> str:
    """What makes two mentions alike."""
    if "@" in text:
        user, _, host = text.lower().strip(".,;:()<>\"'").partition("@")
        return f"{user}@{host.split('.')[0]}"
    if text.count(".") in (2, 3) and text.replace(".", "").isdigit():
        return ".".join(text.split(".")[:3])
    return NOT_DIGIT.sub("", text)[-7:]


def shortened(kind: int, text: str) -> str:
    """A form of a base span that the patterns no longer accept."""
    if kind == 0:
        return text.rsplit("@", 1)[0] + "@" + text.rsplit("@", 1)[1].split(".")[0]
    if kind == 1:
        return text.rsplit(".", 1)[0]
    digits = NOT_DIGIT.sub("", text)
    return digits[4:] if kind == 2 else digits[-10:]


def _longest(edges: list[tuple[int, int]]) -> int:
    """Edges of the longest path that never turns back; edges are ordered by their later end."""
    far: dict[int, int] = {}
    for i, j in edges:
        far[j] = max(far.get(j, 0), far.get(i, 0) + 1)
    return max(far.values(), default=0)


class Graph:
    """Nodes, features and the two kinds of edges of one document."""

    def __init__(self, text: str, base: list[Span]):
        self.nodes = mentions(text, base)
        self.seen = np.array([k for k, _, _ in self.nodes], dtype=np.int64)
        words = [text[s:e] for _, s, e in self.nodes]
        self.x = np.array([features(w) for w in words]) if words else np.empty((0, 0))
        chain = [(i, i + 1) for i in range(len(words) - 1) if self.nodes[i + 1][1] - self.nodes[i][2] <= NEAR]
        last: dict[str, int] = {}
        full: dict[str, int] = {}  # the last base span of a key
        early: dict[str, list[int]] = {}  # mentions before the first one
        skip = []
        for i, w in enumerate(words):
            k = key(w)
            if k in last:
                skip.append((last[k], i))
            if self.seen[i] >= 0:
                skip += [(j, i) for j in early.pop(k, ()) if j != last[k]]
                full[k] = i
            elif k not in full:
                early.setdefault(k, []).append(i)
            elif full[k] != last[k]:
                skip.append((full[k], i))
            last[k] = i
        self.longest = _longest(chain) + _longest(skip)
        self.edges = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
        self.kind = np.array([CHAIN] * len(chain) + [HELD if self.seen[i] >= 0 or self.seen[j] >= 0 else ALIKE for i, j in skip], dtype=np.int64)


CHAIN, HELD, ALIKE = range(3)  # edges: neighbours in the text; skip from a base span; skip between mentions


class Field:
    """Weights: of features (features x labels), of neighbouring labels (left x right), of agreement with a
    base span (per label) and of agreement between mentions (one number)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, held: np.ndarray, alike: float):
        self.unary, self.chain, self.held, self.alike = unary, chain, held, alike

    def potential(self, kind: int) -> np.ndarray:
        """Log potential of an edge by the labels of its earlier and later end."""
        return self.chain if kind == CHAIN else np.diag(self.held if kind == HELD else np.full(len(LABELS), self.alike))

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product with the observed labels clamped."""
        n, k = len(g.nodes), len(LABELS)
        local = g.x @ self.unary
        known = g.seen >= 0
        local[known] = -1e4
        local[known, g.seen[known]] = 0.0
        m = len(g.edges)
        if m:
            src = np.concatenate((g.edges[:, 0], g.edges[:, 1]))
            dst = np.concatenate((g.edges[:, 1], g.edges[:, 0]))
            back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
            of = [(at + way * m, np.exp(self.potential(e) if not way else self.potential(e).T))
                  for e in (CHAIN, HELD, ALIKE) for at in [np.flatnonzero(g.kind == e)] if len(at) for way in (0, 1)]
            msg = np.full((2 * m, k), -np.log(k))
            for _ in range(ROUNDS + 2 * g.longest):  # damped by half, so two rounds a link; the gap mostly ends it before
                total = local.copy()
                np.add.at(total, dst, msg)
                out = total[src] - msg[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.empty_like(msg)
                for at, bond in of:
                    new[at] = np.log(out[at] @ bond)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                gap = np.abs(new - msg).max()
                msg = 0.5 * msg + 0.5 * new
                if gap < 1e-4:
                    break
            np.add.at(local, dst, msg)
        p = np.exp(local - local.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True) if n else p

    def more_spans(self, text: str, base: list[Span], threshold: float = 0.5) -> list[Span]:
        g = Graph(text, base)
        if not len(g.nodes) or (g.seen >= 0).all():
            return []
        p = self.marginals(g)
        best = p.argmax(1)
        return [(int(best[i]) - 1, s, e) for i, (k, s, e) in enumerate(g.nodes) if k < 0 and best[i] and p[i, best[i]] >= threshold]

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind, then start."""
        text = text or ""
        base = base_spans(text)
        return base, sorted(base + self.more_spans(text, base), key=lambda x: x)


def fit(texts: list[str | None], steps: int = 400, l2: float = 1e-3) -> Field:
    """Pseudo-likelihood: each mention given its features and the labels of its neighbours."""
    k_all = len(LABELS)
    xs, ys, lefts, rights, helds, alikes = [], [], [], [], [], []

    def learn(x, y, left=None, right=None, held=None, alike=None):
        none = np.zeros((len(y), k_all))
        for out, part in zip((xs, ys, lefts, rights, helds, alikes), (x, y, *(none if p is None else p for p in (left, right, held, alike)))):
            out.append(part)

    for t in texts:
        g = Graph(t or "", base_spans(t or ""))
        if not len(g.nodes):
            continue
        y = np.maximum(g.seen, 0)
        left, right, held, alike = (np.zeros((len(y), k_all)) for _ in range(4))
        for (i, j), e in zip(g.edges, g.kind):
            if e == CHAIN:
                right[i, y[j]] += 1
                left[j, y[i]] += 1
            elif e == ALIKE:
                alike[i, y[j]] += 1
                alike[j, y[i]] += 1
            elif g.seen[i] < 0 or g.seen[j] < 0:  # from a base span to a mention
                a, b = (i, j) if g.seen[i] < 0 else (j, i)
                held[a, y[b]] += 1
        learn(g.x, y, left, right, held, alike)
        short = [(k, features(shortened(k - 1, t[s:e]))) for k, s, e in g.nodes if k > 0]
        if short:
            kinds, x = np.array([k for k, _ in short]), np.array([x for _, x in short])
            full, other = np.zeros((len(short), k_all)), np.zeros((len(short), k_all))
            full[np.arange(len(short)), kinds] = 1
            other[:, 0] = 1
            learn(x, kinds, held=full)
            learn(x, np.zeros_like(kinds))
            learn(x, np.zeros_like(kinds), alike=other)
    unary, chain, held_w, alike_w = np.zeros((len(features("0")), k_all)), np.zeros((k_all, k_all)), np.zeros(k_all), 0.0
    if not xs:
        unary[0, 0] = 5.0
        return Field(unary, chain, held_w, alike_w)
    x, y = np.concatenate(xs), np.concatenate(ys)
    left, right, held, alike = (np.concatenate(p) for p in (lefts, rights, helds, alikes))
    target = np.eye(k_all)[y]
    gu, gc, gh, ga = np.full_like(unary, 1e-8), np.full_like(chain, 1e-8), np.full_like(held_w, 1e-8), 1e-8
    for _ in range(steps):
        z = x @ unary + left @ chain + right @ chain.T + held * held_w + alike * alike_w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (target - p) / len(y)
        du, dc = x.T @ d - l2 * unary, left.T @ d + d.T @ right - l2 * chain
        dh, da = (held * d).sum(0) - l2 * held_w, float((alike * d).sum() - l2 * alike_w)
        gu, gc, gh, ga = gu + du ** 2, gc + dc ** 2, gh + dh ** 2, ga + da ** 2
        unary, chain = unary + 0.5 * du / np.sqrt(gu), chain + 0.5 * dc / np.sqrt(gc)
        held_w = np.clip(held_w + 0.5 * dh / np.sqrt(gh), 0.0, 8.0)  # agreement attracts
        alike_w = min(max(alike_w + 0.5 * da / ga ** 0.5, 0.0), 8.0)
    return Field(unary, chain, held_w, alike_w)


def train(docs: DataFrame, text_col: str = "text", max_train: int = MAX_TRAIN) -> Field:
    """Fit on at most ``max_train`` texts with digits or ``@``: those first by a hash of the text."""
    src = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    first = src.select(F.xxhash64("text").alias("h")).orderBy("h").limit(max_train)
    top = max((r["h"] for r in first.collect()), default=None)
    if top is None:
        return fit([])
    return fit([r["text"] for r in src.where(F.xxhash64("text") <= top).dropDuplicates(["text"]).orderBy(F.xxhash64("text")).limit(max_train).toLocalIterator()])


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, base_sha256, spans): base counts and digest, all spans as text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(texts):
        counts = [[] for _ in KINDS]
        base_text, sha, found = [], [], []
        for t in texts:
            base, spans = field.spans(t)
            for k, c in enumerate(counts):
                c.append(sum(b[0] == k for b in base))
            shown = show(base)
            base_text.append(shown)
            sha.append(hashlib.sha256(shown.encode()).hexdigest())
            found.append(show(spans))
        return [*counts, base_text, sha, found]

    names = [*(f"n_{k}" for k in KINDS), "base", "base_sha256", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 3
    schema = f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in zip(names, types))
    return src.mapInArrow(by_text(run, "text", names, types, ["id"]), schema)


def redact(text: str | None, field: Field) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one."""
    if text is None:
        return None
    out, pos = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in field.spans(text)[1]):
        if s >= pos:
            out += [text[pos:s], f"[{KINDS[k].upper()}]"]
        pos = max(pos, e)
    return "".join(out) + text[pos:] if out else text


def redacted_column(field: Field, text_col: str = "text"):
    """Column of redacted texts (Pandas UDF)."""
    @F.pandas_udf("string")
    def clean(text):  # noqa: ANN001
        import pandas as pd
        return pd.Series([redact(t, field) for t in text], dtype=object)
    return clean(F.col(text_col))
