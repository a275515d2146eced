"""Run detection, conversation repair and language identification against brute force, with their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lowdata.llm import conversations as cv
from lowdata.llm import langid, runs
from lowdata.llm.common import crc_fold, table
from lowdata.llm.registry import LLM_QUERIES
from tests.conftest import MEDIUM, SMALL
from tests.llm.test_operators_llm import ROWS, edge, empty

# ---------------------------------------------------------------- runs


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            w = [rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 70))]
            if rnd.random() < 0.4:
                w = w[:rnd.randint(0, 6)] * rnd.randint(1, 9) + w
            texts.append(w)
        assert runs.find_runs(texts) == [brute_runs(w) for w in texts]


def test_runs_of_long_texts():
    assert runs.find_runs([[b"a"] * 50_000, [b"x", b"y", b"z"] * 9_000 + [b"x"]]) == [[(0, 50_000, 1)], [(0, 27_001, 3)]]
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    assert runs.find_runs([list(fib[-1])])[0] == brute_runs(fib[-1])


def test_runs_small_slabs(monkeypatch):
    monkeypatch.setattr(runs, "SLAB", 7)
    rnd = random.Random(4)
    w = [rnd.randrange(2) for _ in range(400)]
    assert runs.find_runs([w])[0] == brute_runs(w)


def test_runs_edges(spark):
    text = "Go a b a b a b a b stop\x0bo o\to o\no o  x"
    rows = [*ROWS, (9, text)]
    found = {(r["id"], r["start"], r["length"], r["period"]) for r in runs.find(edge(spark, rows)).collect()}
    assert {(9, 1, 8, 2), (9, 10, 6, 1), (6, 0, 30_000, 1)} <= found
    flat = {r["id"]: r["text"] for r in runs.collapse(edge(spark, rows)).where("id is not null").collect()}
    assert flat[9] == "Go a b stop o  x" and flat[1] == flat[2] == flat[3] == "" and flat[6].startswith("word xx")
    out = runs.digest(edge(spark, rows)).collect()
    assert len(out) == len(rows)
    none = [r for r in out if r["id"] in (1, 2, 3)]
    assert all((r["n_runs"], r["start"], r["exponent_milli"], r["collapsed_sha256"]) == (0, None, None, hashlib.sha256(b"").hexdigest()) for r in none)
    assert runs.digest(empty(spark)).count() == 0


# ---------------------------------------------------------------- conversations


def exhaustive(codes):
    """Least (cost, audit) over all edit sequences with up to three inserts at a place."""
    inserts = ["".join(i) for k in range(4) for i in itertools.product("ua", repeat=k)]
    ways = [[i + o for i in inserts for o in (["D"] if c in "bd" else ["D", "K", "Ru", "Ra"])] for c in codes]
    best = None
    for combo in itertools.product(*ways, inserts):
        roles, cost, audit = "", 0, ""
        for c, way in zip(codes + "$", combo):
            for e in re.findall("R.|.", way):
                audit += "I" if e in "ua" else e[0]
                cost += {"D": 4, "K": 0}.get(e, 3) + (3 if c.isupper() and e[0] in "KR" else 0)
                roles += "" if e == "D" else c.lower() if e == "K" else e[-1]
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
    return best


def least(codes):
    """The same by carrying whole strings through the four states."""
    now = {cv.START: (0, "")}
    for c in codes + cv.END:
        later = {}
        for p, (cost, audit) in now.items():
            for to, price, edits in cv.STEPS[c][p]:
                later[to] = min(later.get(to, (10 ** 9, "")), (cost + price, audit + edits))
        now = later
    return now[cv.START]


def test_repair_matches_exhaustive_search():
    for n in (0, 1, 2):
        for codes in map("".join, itertools.product("bsuaoSUA", repeat=n)):
            assert exhaustive(codes) == least(codes) and "".join(cv.edits_of(codes + cv.END)) == least(codes)[1]


def test_repair_by_halves_and_segments():
    rnd = random.Random(2)
    for _ in range(600):
        codes = "".join(rnd.choice("bdsuaoSUAOuaua") for _ in range(rnd.randint(2, 60)))
        cuts = sorted(rnd.sample(range(1, len(codes)), min(rnd.randint(1, 5), len(codes) - 1)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        parts[-1] += cv.END
        between = cv.crossings([cv.matrix(p) for p in parts])
        assert "".join("".join(cv.edits_of(p, a, b)) for p, (a, b) in zip(parts, between)) == least(codes)[1]


def brute_digest(rows):
    """The contract of op12, row by row."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        by[conv] += []
        if h:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
            by[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, some in by.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, codes, n = set(), "", dict.fromkeys("bdt", 0)
        for _, role, text in some:
            core = text.strip(" \t\n\x0b\x0c\r")
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            code = "b" if not core else "d" if (role, text) in seen else c if core[-1] in ".!?" else c.upper()
            seen.add((role, text))
            n["b"] += code == "b"
            n["d"] += code == "d"
            n["t"] += code.isupper()
            codes += code
        turns = [t for t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit = least(codes)
        told, state, i = [], 0, 0
        for e in audit:
            if e == "I":
                told.append((cv.ROLE_AFTER[state], ""))
            elif e == "R":
                told.append((cv.ROLE_AFTER[state], some[i][2]))
            elif e == "K":
                told.append(some[i][1:])
            i += e != "I"
            if e != "D":
                state = cv.NEXT[state, told[-1][0][0]]
        text = "\n".join(f"{r}:{t}" for r, t in told)
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


ODD = "conv_id bigint, turn bigint, role string, text string, at bigint, kind int, codes string, edits string, gone boolean, block int"


def odd_conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", "e", True, 3) for r in rows], ODD)


def random_rows(seed, n, convs):
    """Odd rows with distinct (conversation, turn), some of them null."""
    rnd = random.Random(seed)
    rows = {}
    for _ in range(n):
        key = (rnd.choice(convs), rnd.choice([None, *range(n)]))
        rows[key] = (*key, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rnd.choice([None, "", " \t", "Hi.", "What?", "no end", "Yes!\n", "tail  ", f"{rnd.random()}."]))
    return list(rows.values())


@pytest.mark.parametrize("segment", [1024, 3])
def test_conversations_match_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    rows = random_rows(5, 400, [1, 1, 1, 1, 2, 3, None]) + [(77, t, "user", "Hi.") for t in range(3000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0]
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.digest(cv.damage(odd_conversations(spark, rows))).collect()}
    assert got == brute_digest(rows)
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_conversations_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "  "), (2, None, None, None)]
    out = cv.repair(odd_conversations(spark, rows)).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in out] == [(1, 0, "K", 0, "system", "Be brief."), (1, 1, "I", None, "user", ""), (1, 2, "K", 1, "assistant", "Hello.")]
    assert cv.repair(odd_conversations(spark, [])).count() == cv.digest(cv.damage(odd_conversations(spark, []))).count() == 0


# ---------------------------------------------------------------- language


def test_language_held_out_accuracy(spark):
    docs = table(spark, MEDIUM, "documents")
    out = {r["doc_id"]: r for r in LLM_QUERIES["op13_language"][0](spark, MEDIUM).collect()}
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d in known if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(out) == len(known) and all(out[d]["held_out"] == (d in set(held)) for d in known)
    assert sum(out[d]["lang_pred"] == known[d] for d in held) >= 0.98 * len(held)


def test_language_matches_brute_force(spark, monkeypatch):
    """Counts, smoothing and posterior by the formula, with pieces of a few characters and few count rows a task."""
    docs = table(spark, SMALL, "documents").limit(60)
    whole = langid.train(docs, buckets=512)
    monkeypatch.setattr(langid, "CHUNK", 37)
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 1)
    rows = docs.select("lang", "text").collect()
    counts, n = defaultdict(lambda: np.full(512, langid.ALPHA)), defaultdict(int)
    for r in rows:
        n[r["lang"]] += 1
        for _, cells in langid.ngrams([r["text"]], 512):
            np.add.at(counts[r["lang"]], cells, 1)
    names = sorted(n)
    matrix = np.stack([np.log(counts[k] / counts[k].sum()) for k in names], axis=1)
    assert whole.names == names and np.allclose(whole.matrix, matrix)
    text = "Straße und der die the of é"
    total = np.log([n[k] / len(rows) for k in names]) + sum(matrix[c].sum(0) for _, c in langid.ngrams([text], 512))
    lang, score = whole.predict([text])
    p = np.exp(total - total.max())
    assert lang == [names[int(total.argmax())]] and np.isclose(score[0], p.max() / p.sum())


def test_language_ngrams():
    """All n-grams of words with a space on both sides, and no others."""
    text = "Été 3x, a_b"
    grams = [w[i:i + n] for w in (" été ", " x ", " a ", " b ") for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i:i + n] != " "]
    cells = np.concatenate([c for _, c in langid.ngrams([text], 1 << 16)])
    assert len(cells) == len(grams) and len(set(cells.tolist())) == len(set(grams))


def test_language_edges(spark):
    rows = [*ROWS, (9, "12 !?"), (10, "日本語"), (11, "ÀÉ")]
    df = edge(spark, rows).withColumnRenamed("shard", "lang")
    out = langid.identify(df, langid.train(df)).collect()
    assert len(out) == len(rows)
    assert {r["lang_pred"] for r in out if r["id"] in (1, 2, 3, 9)} == {"und"} and {r["score"] for r in out if r["id"] in (1, 9)} == {0.0}
    assert {r["lang_pred"] for r in out if r["id"] in (4, 6, 7, 10, 11)} == {"z"} and all(0 <= r["score"] <= 1 for r in out)
    nothing = langid.train(df.where("doc_id < 0"))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), nothing).count() == 0
    fold = df.where(crc_fold("doc_id", 4) != 2).where("doc_id is null").count()
    assert fold == 0  # rows without an id are never learned from
