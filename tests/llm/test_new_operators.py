"""Resampling, mixture packing and conversation repair against brute force, on small and awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom.llm import html_text, mixture, repair, resampling
from alphaloom.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = ["score", "place", "part", "at", "n", "ids", "queue", "able", "first", "summary", "head", "digest", "code"]


def table(spark, texts, sources=("s",)):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)], DOCS)


def awkward(spark):
    base = table(spark, [None, "", "a", "the same text " * 12, "the same text " * 12, "word " * 9000, "<|endoftext|> x", "É \n\n Σας it's\x1c½ " + "z" * 300], ["s", None, "t"])
    rows = base.unionByName(base.where("doc_id = 3")).unionByName(base.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    return rows.withColumns({c: F.lit(1) for c in EXTRA})


# ---- 11 resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text):
    w = words_of(text)
    return [x.encode() for x in w] + [f"{a} {b}".encode() for a, b in zip(w, w[1:], strict=False)]


def plain_resample(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    own, wanted = collections.Counter(), collections.Counter()
    for _, t in docs:
        own.update(zlib.crc32(f) % buckets for f in features_of(t))
    for t in target:
        wanted.update(zlib.crc32(f) % buckets for f in features_of(t))
    s_all, t_all = sum(own.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
    out = []
    for d, t in docs:
        f = features_of(t)
        weight = sum(gain(zlib.crc32(x) % buckets) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(t)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted([tuple(r[:5]) for r in out], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_features_of_blocks(monkeypatch):
    texts = ["Hello World foo", "", "é a1 " + "x" * 60 + " " + "y" * 100 + " b", "", "abc", "def ghi", "z" * 49 + " " + "q" * 48 + " É"]
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK", size)
        got = [[] for _ in texts]
        for _, row, crc in resampling.features(pa.array(texts)):
            for r, c in zip(row, crc, strict=True):
                got[r].append(int(c))
        assert [sorted(g) for g in got] == [sorted(map(zlib.crc32, features_of(t))) for t in texts]
    assert [r.tolist() for r, _, _ in resampling.features(pa.array(texts).slice(4, 2))] == [[0, 1, 1]]


def test_resampling(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert rows_of(q.op11_resampling(spark, sf_dir)) == plain_resample(docs, target)


@pytest.mark.parametrize(("percent", "least"), [(0, 1), (25, 20), (50, 1), (100, 0)])
def test_resampling_of_awkward_documents(spark, percent, least):
    docs, target = awkward(spark), spark.createDataFrame([("the same word",), (None,)], "text string")
    got = resampling.resample(docs, target, percent=percent, min_words=least, buckets=97)
    assert rows_of(got) == plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], ["the same word", None], 97, percent, least)
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0), buckets=97, min_words=1).count() == docs.count()


def test_draws_among_ties(spark):
    """Scores that tie at the cutoff, repeated and null ids: exactly as many ranks as are wanted, in order."""
    docs = spark.createDataFrame([(i if i < 30 else 7 if i < 60 else None, "same words here") for i in range(90)], "doc_id long, text string")
    for percent in (1, 30, 60, 95):
        got = resampling.resample(docs, docs.select("text"), percent=percent, min_words=1)
        drawn = sorted((r for r in got.collect() if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, 90 * percent // 100 + 1))
        want = sorted((r for r in got.collect()), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))[: len(drawn)]
        assert [(r["score"], r["doc_id"]) for r in drawn] == [(r["score"], r["doc_id"]) for r in want]


# ---- 12 mixture packing


def check_mixture(rows, docs, capacity=2048, end_id=1):
    """Whole ids once each, gapless sequences, no padding; gives each full window's sources."""
    import public_tokenizers as files
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(files.path("word_bpe_49k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in docs.items():
        ids, at = [*full.encode(text or "", add_special_tokens=False).ids, end_id], 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    windows = {}
    for s, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        if at == capacity:
            windows[s] = collections.Counter()
            for r in own:
                windows[s][r["source"]] += r["length"]
    return windows


def test_mixture_keeps_shares(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_mixture(q.op12_mixture_packing(spark, sf_dir).collect(), texts)
    rows = mixture.pack_mixture(docs.repartition(5), group=4, with_ids=False).collect()
    windows, total = check_mixture(rows, texts), collections.Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    for own in windows.values():
        for source, n in total.items():
            # rounding in a window and in the one before it
            assert abs(own[source] - 2048 * n / sum(total.values())) <= len(total)


def test_mixture_of_targets(spark):
    """A source with nine tenths as its target leads until it is empty; then the others fill the windows."""
    rng = random.Random(5)
    docs = table(spark, [" ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 400))) for _ in range(300)], ["a", "b", "c"])
    rows = mixture.pack_mixture(docs, targets={"a": 0.9, "b": 0.05, "c": 0.05}, capacity=256, group=8, with_ids=False).collect()
    windows = check_mixture(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 256)
    order = [windows[s] for s in sorted(windows)]
    led = next(k for k, w in enumerate(order) if w["a"] < 200)
    assert led > 20 and all(abs(w["a"] - 0.9 * 256) <= 3 and abs(w["b"] - 12.8) <= 3 for w in order[:led]) and all(w["a"] == 0 for w in order[led + 1 :])


def test_mixture_of_awkward_documents(spark):
    docs = awkward(spark)
    one_each = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for queues in (1, 2, 256):
        check_mixture(mixture.pack_mixture(one_each, group=2, queues=queues, with_ids=False).collect(), {r["doc_id"]: r["text"] for r in one_each.collect()})
    rows = mixture.pack_mixture(docs).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 9001 and sum(r["start"] == 0 for r in rows) == docs.count()
    assert mixture.pack_mixture(docs.limit(0)).count() == 0


def test_words_are_encoded_as_by_the_file():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    path = files.path("word_bpe_49k.json")
    full, own = Tokenizer.from_file(path), mixture.WordEncoder(path)
    rng = random.Random(3)
    texts = ["a" + chr(c) + "b " + chr(c) for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x2000, 0x3100), 0x1F600, 0xAC00, 0x1100, 0x301])) for _ in range(60)) for _ in range(800)]
    texts += ["ΑΣ ΑΣΑ. İi", "it's WE'LL don't'", "x" * 5000, "<|startoftext|>a <|ENDOFTEXT|>", " \n\t ", ""]
    for t, e in zip(texts, full.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own(t), own.dtype).tolist() == e.ids, t


# ---- 13 conversation repair


def cheapest(codes):
    """(cost, audit) by trying every edit."""
    best = None

    def go(i, out, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if i < len(codes):
            role, fault = "uaso"[codes[i] & 3], codes[i] >> 2
            go(i + 1, out, cost + 4, audit + "D")
            if fault not in (repair.BLANK, repair.DUPLICATE):
                kept = cost + 3 * (fault == repair.CUT_OFF)
                go(i + 1, out + role, kept, audit + "K")
                for r in "ua":
                    go(i + 1, out + r, kept + 3, audit + "R")
        if cost + 3 <= 4 * len(codes):
            for r in "ua":
                go(i, out + r, cost + 3, audit + "I")

    go(0, "", 0, "")
    return best


def test_alignment_against_every_edit():
    rng = random.Random(3)
    assert repair.align(b"") == (0, "")
    for _ in range(500):
        codes = bytes(rng.choice([0, 1, 2, 3, 0, 1]) | rng.choice([0, 0, 0, 1, 2, 3]) << 2 for _ in range(rng.randint(0, 5)))
        assert repair.align(codes) == cheapest(codes), list(codes)


def by_states(codes):
    """(cost, audit) from the costs to go of the grammar's states: nothing yet, system, user, assistant."""
    far, then, made = 10**9, {(0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2, (0, "s"): 1}, "uuau"
    after = [then[s, made[s]] for s in range(4)]

    def inserted(costs):
        for _ in range(3):
            costs = [min(costs[s], 3 + costs[after[s]]) for s in range(4)]
        return costs

    turns = [("uaso"[c & 3], c >> 2 in (repair.BLANK, repair.DUPLICATE), 3 * (c >> 2 == repair.CUT_OFF)) for c in codes]
    rows = [inserted([0, far, far, 0])]
    for role, gone, kept in reversed(turns):
        costs = [4 + c for c in rows[-1]]
        if not gone:
            costs = [min(c, kept + 3 + rows[-1][after[s]], kept + rows[-1][then[s, role]] if (s, role) in then else far) for s, c in enumerate(costs)]
        rows.append(inserted(costs))
    rows.reverse()
    i = state = 0
    audit, left = "", rows[0][0]
    while i < len(turns) or left:
        role, gone, kept = turns[i] if i < len(turns) else ("", True, 0)
        if i < len(turns) and rows[i + 1][state] + 4 == left:
            audit, i = audit + "D", i + 1
        elif rows[i][after[state]] + 3 == left:
            audit, state = audit + "I", after[state]
        elif not gone and (state, role) in then and rows[i + 1][then[state, role]] + kept == left:
            audit, state, i = audit + "K", then[state, role], i + 1
        else:
            audit, state, i = audit + "R", after[state], i + 1
        left = rows[i][state]
    return rows[0][0], audit


@pytest.mark.parametrize("block", [3, 1024])
def test_alignment_of_long_conversations(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(4)
    for k in range(600):
        roles = rng.choice([[0, 1], [0, 1, 2, 3], [2, 2, 2, 0], [0, 0, 0, 0, 1], [3, 2]])
        codes = bytes(rng.choice(roles) | rng.choice([0] * rng.randint(1, 9) + [1, 2, 3]) << 2 for _ in range(rng.randint(0, 60) if k else 5000))
        assert repair.align(codes) == by_states(codes), list(codes)


def plain_repair(rows):
    """op13's rows from (conv_id, turn, role, text), one conversation after another."""
    spaced = lambda v: " " if v is None else str(v)
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", spaced(text)) if kind == 2 else spaced(text)
        convs[conv] += [(turn, "user" if kind == 4 else spaced(role), text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, codes, faults = set(), [], collections.Counter()
        for _, role, text in turns:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = repair.BLANK if not last else repair.DUPLICATE if (role, text) in seen else repair.NONE if last in ".!?" else repair.CUT_OFF
            seen.add((role, text))
            faults[fault] += 1
            codes.append({"u": 0, "a": 1, "s": 2}.get(role[:1], 3) | fault << 2)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = by_states(codes)
        made, left = [], iter(turns)
        system = len(audit.replace("D", "")) % 2
        for e in audit:
            wanted = ("user", "assistant")[(len(made) - system) % 2]
            turn = next(left) if e != "I" else None
            if e != "D":
                made.append(f"{wanted}:" if e == "I" else f"{wanted if e == 'R' else turn[1]}:{turn[2]}")
        out.append((conv, gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_repair(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(q.op13_conversation_repair(spark, sf_dir)) == plain_repair(given)


def test_repair_of_awkward_conversations(spark, tmp_path):
    rng = random.Random(6)
    texts = ["Fine.", "fine", "", " \t", None, "Long " * 5000 + "end!", "ü?\n", "a.b", "é"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(15)]), rng.choice(["user", "assistant", "system", "", None, "tool", "usher"]), rng.choice(texts)) for _ in range(300)]
    # one conversation with a third of all rows, a gone one, repeated rows
    rows += [(99, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(200)] + rows[:20]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Hello."))
    spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in EXTRA}).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain_repair(rows)
    assert rows_of(q.op13_conversation_repair(spark, str(tmp_path))) == want
    # the repaired turns are those that the digest is of
    edits = collections.defaultdict(list)
    turns = repair.damaged(spark.createDataFrame(rows, TURNS))
    for r in repair.repaired_turns(turns).collect():
        edits[r["conv_id"]].append((r["step"], r["edit"], r["role"], r["text"]))
    for conv, *_, audit, digest in want:
        own = sorted(edits[conv])
        assert "".join(e for _, e, _, _ in own) == audit
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, e, r, t in own if e != "D").encode()).hexdigest() == digest
    empty = turns.limit(0)
    assert repair.repaired_turns(empty).count() == 0 and repair.repaired_conversations(empty).count() == 0


# ---- 5 page text: blocks beside an article, in several templates

PARAGRAPHS = [f"Paragraph {i} tells of the river, the town and its people at some length. It has three sentences, as most have; this is the second. The third one ends it." for i in range(6)]
BESIDE = {
    "advert": "<div class='x7'><p>Buy our great new shoes today, only this week.</p></div>",
    "comments": "<section class='responses'><p>Bob wrote: I disagree with that.</p><p>Ann wrote: So do I.</p></section>",
    "sidebar": "<div class='col-right'><h3>Popular</h3><p>Ten best pubs.</p></div>",
    "notice": "<div class='legal'><p>We use small text files to keep you signed in.</p></div>",
    "links": "<div class='more'><ul><li><a href=a>One story</a></li><li><a href=b>Another story</a></li></ul></div>",
}
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEMPLATES = {
    "article": "<html><body><div class=page><article><h1>Title of it</h1>{body}</article>{block}</div></body></html>",
    "before": "<html><body><div class=page>{block}<article><h1>Title of it</h1>{body}</article></div></body></html>",
    "main": "<html><body><main><div class=post><h1>Title of it</h1>{body}</div></main>{block}</body></html>",
    "plain": "<html><body><div class=wrap><div class=post><h1>Title of it</h1>{body}</div>{block}</div></body></html>",
    "titled": "<html><body><div class=wrap><div class=b><h1>Title of it</h1><div class=text>{body}</div></div>{block}</div></body></html>",
}


@pytest.mark.parametrize("template", TEMPLATES)
@pytest.mark.parametrize("beside", BESIDE)
def test_blocks_beside_an_article(template, beside):
    page = TEMPLATES[template].format(body=BODY, block=BESIDE[beside])
    assert html_text.main_text(page) == "\n".join(["Title of it", *PARAGRAPHS])


def test_parts_of_an_article_stay():
    text = lambda page: html_text.main_text(page).split("\n")
    short = "<div class=note-box>Short, true.</div>"
    assert text(f"<html><body><div class=b><h1>Title</h1><div>{BODY}</div>{short}</div></body></html>") == ["Title", *PARAGRAPHS, "Short, true."]
    assert text(f"<html><body><article><h1>Title</h1><p>Lead.</p><div>{BODY}</div><blockquote>Yes.</blockquote></article></body></html>") == ["Title", "Lead.", *PARAGRAPHS, "Yes."]
    halves = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:1])
    assert text(f"<html><body><div><section>{BODY}</section><section>{halves}</section></div></body></html>") == [*PARAGRAPHS, PARAGRAPHS[0]]
