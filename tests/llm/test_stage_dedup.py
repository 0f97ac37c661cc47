from test_text import docs, prose, shingles

from meshloom.llm import minhash


def test_stage_drops_near_copies_from_four_fifths_on(spark):
    """Texts of 200 words, copies with 3, 4 or 5 words changed far apart: 0.86, 0.815 and 0.77 of their shingles shared."""
    rows, want = [], set()
    for k in range(60):
        w = prose(200).split()
        rows.append((10 * k, " ".join(w)))
        want.add(10 * k)
        for n in (3, 4, 5):
            new = list(w)
            for i in range(n):
                new[20 + 40 * i - 2 * (n == 5)] = f"changed{k}x{n}x{i}"
            rows.append((10 * k + n, " ".join(new)))
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}
    for k in range(60):  # components by the least id, links within a family only
        family = [i for i in sorted(sets) if i // 10 == k]
        for _ in family:
            for a in family:
                for b in family:
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        up[a] = up[b] = min(up[a], up[b])
    assert sum(up[i] == i for i in up) == 120 and all(up[10 * k + 4] == 10 * k for k in range(60))
    got = minhash.stage(spark, docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i in up if up[i] == i)
