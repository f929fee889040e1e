import math
import re
import zlib
from collections import Counter

import public_tokenizers

from loomgraph.llm.lm_scoring import Lattice, lattice_scores, piece_logs, score_shares
from loomgraph.llm.piece_codec import MARKER, processor

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "the cat sat on the mat", "The DOG sat", None, "", "naïve café 漢字 \U0001f600", "zyzzyva the", "the the the the\nthe", "É é",
    "a" * 300 + " tail", "cat dog " * 50, "unseen words only", "on on on",
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_word(lattice, word):
    text = MARKER + word
    ways = {0: 1.0}

    def prob(at):
        if at == len(text):
            return 1.0
        out = sum(math.exp(lattice.piece[text[at:e]]) * prob(e) for e in range(at + 1, len(text) + 1) if text[at:e] in lattice.piece)
        if text[at] not in lattice.piece:
            out += math.exp(sum(lattice.byte[b] for b in text[at].encode())) * prob(at + 1)
        return out

    del ways
    return math.log(prob(0))


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, TEXTS[i % len(TEXTS)]) for i in range(12, 60)] + [(None, "the cat"), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS n")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words, pieces, ends = Counter(), Counter(), 0
    sp = processor(MODEL)
    for i, t in rows:
        if not out(i):
            ws = WORD.findall(lower(t))
            words.update(ws)
            ends += 1
            for w in ws:
                pieces.update(sp.encode(w))
    n, v = sum(words.values()) + ends, len(words) + 1
    logs = piece_logs(pieces, score_shares(MODEL), ends, sp.eos_id())
    lattice = Lattice(MODEL, logs)
    end_log = float(logs[sp.eos_id()])
    want = []
    for i, t in rows:
        ws = WORD.findall(lower(t))
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(words[w] for w in ws), ends])
        score = (sum(map(lattice, ws)) + end_log) / math.log(10)
        want.append((i, out(i), len(ws) + 1, sum(w in words for w in ws) + 1, n, base, score))
    for share in (2e-6, 0.05, 1.0):
        got = sorted((tuple(r) for r in lattice_scores(df, MODEL, share=share).collect()), key=str)
        assert len(got) == len(want)
        for a, b in zip(got, sorted(want, key=str), strict=True):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)
    for w in ("the", "cat", "naïve", "漢字", "zyzzyva", "xé"):
        assert math.isclose(lattice(w), brute_word(lattice, w), rel_tol=1e-9)


def test_empty(spark):
    assert lattice_scores(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
