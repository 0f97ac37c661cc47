import random
import re

import pytest
from test_text import brute_repeats, docs, prose

from meshloom.llm import repeats

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_passages(texts, n):
    """Each text without its 400-byte strings and its passages of n words that also start anywhere else."""
    raw, seen = [t.encode() for t in texts], {}
    words = [list(WORD.finditer(b)) for b in raw]
    for i, b in enumerate(raw):
        for p in range(len(b) - 399):
            seen.setdefault(b[p : p + 400], []).append((i, p, p + 400))
        for k in range(len(words[i]) - n + 1):
            run = words[i][k : k + n]
            end = words[i][k + n].start() if k + n < len(words[i]) else len(b)
            seen.setdefault(tuple(m.group().lower() for m in run), []).append((i, run[0].start(), end))
    gone = [bytearray(len(b)) for b in raw]
    for at in seen.values():
        for i, a, z in at if len(at) > 1 else ():
            gone[i][a:z] = b"\1" * (z - a)
    return [bytes(x for x, y in zip(b, g, strict=True) if not y).decode("utf-8", "replace") for b, g in zip(raw, gone, strict=True)]


@pytest.mark.parametrize("shard", [repeats.SHARD, 8_000])
def test_short_passages_go_from_every_document(spark, monkeypatch, shard):
    """Passages of 50 words and more, most of them under 400 bytes, with other white space and another first letter."""
    monkeypatch.setattr(repeats, "SHARD", shard)  # the smaller one counts hashes of windows
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 5)))
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 300)]
    texts = [prose(rnd.randint(0, 60), rnd) for _ in range(80)]
    for k in range(120):
        p = passage[k % 6]
        own = " \n".join(p) if k % 4 == 1 else " ".join(p)
        own = own[0].upper() + own[1:] if k % 3 else own
        texts.append(f"{' '.join(word() for _ in range(rnd.randint(0, 9)))} {own} {' '.join(word() for _ in range(rnd.randint(0, 9)))}".strip())
    texts += [" ".join(passage[1]), "of " * 70, "", " ".join(word() for _ in range(400))]
    rows = [(i, t, "a", "xx") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.stage(spark, docs(spark, rows, extra=True), "", words=50).collect()}
    want = without_passages(texts, 50)
    assert got == {i: (w, len(w)) for i, (t, w) in enumerate(zip(texts, want, strict=True)) if w or not t}
    short = [i for i, (t, c) in enumerate(zip(texts, brute_repeats(texts), strict=True)) if not c[1] and want[i] != t]
    assert len(short) > 40  # of which 400-byte strings catch nothing
    plain = {r.doc_id: r.text for r in repeats.stage(spark, docs(spark, rows, extra=True), "").collect()}
    assert all(plain[i] == texts[i] for i in short)
