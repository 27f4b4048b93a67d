import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusspark.llm import splitting


def pieces_of(text, size=1200, overlap=150):
    ends = splitting.merged_cuts(text, size, overlap) if len(text) > size else [(len(text), 4)]
    start, out = 0, []
    for end, strength in ends:
        out.append((start, end, strength))
        start = end - overlap
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", ". ", "\n\n", "x" * 40, "Ende! ", "\r\n\r\n", "é"]), min_size=1, max_size=200))
def test_pieces_cover_the_text(parts):
    text = "".join(parts)
    pieces = pieces_of(text, 100, 15)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 <= s < e and e - s <= 100 for s, e, _ in pieces)
    assert all(b[0] == a[1] - 15 for a, b in zip(pieces, pieces[1:]))


def test_natural_boundaries():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(5, 30))) + "." for _ in range(60))
    kinds = [k for _, _, k in pieces_of(text)]
    assert all(k >= 2 for k in kinds)
    words = " ".join(["word"] * 2000)
    assert all(k == 1 for _, _, k in pieces_of(words)[:-1]) and all(words[e : e + 1] in ("", " ") for _, e, _ in pieces_of(words))


def test_merges_as_brute_force():
    """No two neighbours that remain could have been merged."""
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice(["aaa ", "b. ", "c\n\n", "d" * 30]) for _ in range(rng.randint(5, 120)))
        if len(text) <= 100:
            continue
        ends = [e for _, e, _ in pieces_of(text, 100, 15)]
        cores = [b - a for a, b in zip([0, *ends], ends)]
        assert all(x + y + (15 if k else 0) > 100 for k, (x, y) in enumerate(zip(cores, cores[1:])))


def test_operator(spark, messy, docs):
    got = splitting.split_oversized(messy).collect()
    assert {r["doc_id"] for r in got} == {None, 3, 4, 5, 6, 7, 8} and max(len(r["piece"]) for r in got) <= 1200
    assert sum(r["doc_id"] == 8 for r in got) == 2
    found = {r[0] for r in splitting.oversized(docs).collect()}
    assert found == {r[0] for r in docs.where("length(text) > 1200").select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in splitting.split_oversized(docs).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["piece"]
    assert splitting.split_oversized(docs.where("false")).count() == 0
