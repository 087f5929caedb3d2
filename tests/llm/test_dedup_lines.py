import random

from hypothesis import given, settings
from hypothesis import strategies as st

from surveyspark.llm import dedup_lines as dl


def plain(rows, min_words=5):
    """Rows (id, hash, text) to the text without later copies of a unit."""
    first = {}
    order = sorted({(i is not None, i or 0, h, t or "", i) for i, h, t in rows})
    for rank, (_, _, _, text, _) in enumerate(order):
        for number, (s, e) in enumerate(dl.units(text)):
            words = text[s:e].lower().split()
            if len(words) >= min_words:
                first.setdefault(tuple(words), (rank, number))
    out = {}
    for rank, (_, _, h, text, i) in enumerate(order):
        gone = set()
        for number, (s, e) in enumerate(dl.units(text)):
            words = tuple(text[s:e].lower().split())
            if len(words) >= min_words and first[words] != (rank, number):
                gone.add(number)
        out[(i, h)] = gone
    return out


def fixture():
    rng = random.Random(9)
    words = [f"word{i}" for i in range(500)]

    def sentence(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + rng.choice([".", "!", "?"])

    shared = ["The same licence line on every page here", "Short one."] + [sentence(rng.randrange(6, 25)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, shared[0])]
    for d in range(3, 150):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            parts = [sentence(rng.randrange(1, 20)) for _ in range(rng.randrange(1, 5))]
            if rng.random() < 0.4:
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared).upper().replace(" ", "  "))
            lines.append(" ".join(parts))
        if d % 3 == 0:
            lines.append(shared[0])
        rows.append((d, "\n".join(lines)))
    return rows + [rows[30], rows[30], (30, rows[31][1]), (500, (shared[5] + " x y z.\n") * 20_000)]


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, removed int")
    hashes = {(r[0], r[1]): r[2] for r in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    want = plain([(i, hashes[(i, t)], t) for i, t in rows])
    got = dl.dedup(df.repartition(5)).collect()
    assert len(got) == len(rows)
    results = {}
    for i, t in rows:
        gone = want[(i, hashes[(i, t)])]
        text, spans = dl.cut_spans(t, dict.fromkeys(gone, 0)) if t and gone else (t, [])
        results.setdefault(i, []).append((text or "", len(gone)))
    for i in results:
        assert sorted((r["text"] or "", r["n_removed"]) for r in got if r["doc_id"] == i) == sorted(results[i])
    texts = {i: t for i, t in rows if i != 30}
    for r in got:
        if r["doc_id"] in texts and texts[r["doc_id"]]:
            text, at, pieces = texts[r["doc_id"]], 0, []
            for s in r["removed"]:
                assert at <= s["start"] < s["end"] <= len(text)
                pieces.append(text[at:s["start"]])
                at = s["end"]
            assert "".join(pieces) + text[at:] == r["text"]
    assert next(r for r in got if r["doc_id"] == 0)["text"] is None
    assert any(s["kept_id"] is None for r in got for s in r["removed"])  # the null id ranks first


def test_pasted_passage_goes_but_for_its_ends(spark):
    passage = ("Beginning words of the passage that came along. A second sentence of it has quite a few more words in it. "
               "And the third sentence is here with enough words too, at last.")
    rows = [(1, "Own text of the first page " + passage + " tail."), (2, "Something else, then the " + passage + " other tail.")]
    got = {r["doc_id"]: r for r in dl.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed"] == []
    assert "second sentence" not in got[2]["text"] and "third sentence" not in got[2]["text"]
    assert got[2]["removed"][0]["kept_id"] == 1


def test_whole_lines_go_whatever_their_length(spark):
    rows = [(1, "Read more\nOwn words of the first.\n\n-\nles."), (2, "read  MORE\nOwn words of the second, read more\n\n-\nLes."),
            (3, "Les.")]
    got = {r["doc_id"]: r for r in dl.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"].rstrip("\n") == "Own words of the second, read more" and got[2]["n_removed"] == 3
    assert got[3]["text"] == "" and got[3]["removed"][0]["kept_id"] == 1


def test_passages_go_wherever_the_sentences_end(spark):
    """No sentence end, and sentences too short to be units, at shifted places."""
    rng = random.Random(3)

    def words(n):
        return [f"word{i}" for i in rng.choices(range(2000), k=n)]

    passages = [" ".join(words(50)), " ".join(". ".join([" ".join(words(3)) for _ in range(17)]).split())]
    for passage in passages:
        rows = [(i, " ".join([*words(7 + 3 * i), passage, *words(9)])) for i in range(6)]
        got = {r["doc_id"]: r for r in dl.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0]["n_removed"] == 0
        assert all(got[i]["n_removed"] and {s["kept_id"] for s in got[i]["removed"]} == {0} for i in range(1, 6))
    # the same words in steps where none is least
    got = dl.dedup(spark.createDataFrame([(1, "one. " * 60)], "doc_id long, text string")).first()
    assert len(got["text"].split()) < 20


@given(st.text("ab. !?\n", max_size=200))
@settings(max_examples=200, deadline=None)
def test_units_tile_the_text(text):
    at = 0
    for start, end in dl.units(text):
        assert start in (at, at + 1) and end >= start and (start == at or text[at] == "\n")
        at = end
    assert at == len(text)


def test_empty_table(spark):
    assert dl.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
