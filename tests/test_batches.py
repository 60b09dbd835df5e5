import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from cairnflow.functions import segment
from cairnflow.functions.batches import BYTES, ROWS, in_pieces, pieces, text_sizes
from cairnflow.operators.tokenize import tokenize
from cairnflow.plans.catalog import CritiqueStub
from cairnflow.plans.phases import phase2
from cairnflow.plans.provider import PIECE, Stub, generate
from cairnflow.schema import PAIR


def ran(monkeypatch, make) -> list:
    """The functions that make hands to mapInArrow, unwrapped."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda self, run, schema, *a, **k: found.append(run) or self)
        make()
    return found


def texts(n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([None if i % 7 == 3 else f"{i} ".ljust(size, "x") for i in range(n)], pa.string())], ["id", "text"])


def test_pieces_cover_rows_within_bounds():
    for sizes in ([], [0], [None] * 1000, [5, BYTES * 3, 5, None, BYTES, 1], [BYTES // 10] * 95):
        found = list(pieces(sizes))
        assert [i for start, n in found for i in range(start, start + n)] == list(range(len(sizes)))
        assert all(n == 1 or n <= ROWS and sum(x or 0 for x in sizes[start : start + n]) <= BYTES for start, n in found)


def test_tokenize_holds_few_encodings(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    plain = Tokenizer(WordLevel({"?": 0, **{str(i): i + 1 for i in range(50)}}, unk_token="?"))
    plain.pre_tokenizer = Whitespace()
    plain.save(str(tmp_path / "words.json"))
    rows = spark.createDataFrame([], "id long, text string")
    (run,) = ran(monkeypatch, lambda: tokenize(rows, str(tmp_path / "words.json"), {"ids": "text"}))
    for batch in (texts(1000, 10), texts(40, BYTES // 4)):
        made = list(run(iter([batch])))
        assert all(b.num_rows <= ROWS and sum(len(t or "") for t in b.column(1).to_pylist()) <= BYTES for b in made)
        whole = pa.Table.from_batches(made)
        assert whole.select(["id", "text"]).equals(pa.Table.from_batches([batch]))
        assert whole.column("ids").to_pylist() == [plain.encode(t or "").ids for t in batch.column(1).to_pylist()]


def test_text_sizes():
    assert text_sizes(pa.array(["a", None, "éé"]), pa.array([None, None, "b"])) == [1, 0, 5]
    lists = pa.array([["a", None, "éé"], None, [], ["b"]], pa.list_(pa.string()))
    assert text_sizes(lists) == [5, 0, 0, 1] and text_sizes(lists.slice(2, 2)) == [0, 1]


def test_segmentation_holds_few_texts(spark):
    long = [None if i % 7 == 3 else f"$a$ {i}\nb " + "c " * 200 for i in range(1000)]
    made = list(in_pieces(lambda t: segment.segment_steps(t, 64), "list")(iter([pa.array(long), pa.array([], pa.string())])))
    assert [len(m) <= ROWS for m in made] == [True] * len(made) and len(made) > 4
    assert [x for m in made for x in m.to_pylist()] == [None if t is None else segment.segment_steps(t, 64) for t in long]


def test_segmentation_takes_pieces_in_workers(spark, monkeypatch):
    """Both columns go through UDFs over iterators, which alone may give a batch back in pieces."""
    kinds, plain = [], segment.F.arrow_udf
    monkeypatch.setattr(segment.F, "arrow_udf", lambda f, kind, how: kinds.append(how) or plain(f, kind, how))
    rows = spark.createDataFrame([("$a$\nb", ["x", "$y$"])] * 5000 + [(None, None), ("", [])], "t string, l array<string>")
    found = rows.select(segment.segment(segment.F.col("t"), 64).alias("a"), segment.format_trajectory(segment.F.col("l")).alias("b"))
    assert kinds == [segment.F.ArrowUDFType.SCALAR_ITER] * 2
    counts = {(tuple(r["a"]) if r["a"] is not None else None, r["b"]): r["count"] for r in found.groupBy("a", "b").count().collect()}
    assert counts == {(("$a$", "b"), "Step 1: x\nStep 2: $y$"): 5000, (None, None): 1, ((), ""): 1}


def test_generate_holds_few_prompts(spark, monkeypatch):
    calls = []

    class Counting(Stub):
        def __call__(self, prompts, n=1, max_tokens=256):
            calls.append(len(prompts))
            return super().__call__(prompts, n, max_tokens)

    rows, batch = spark.createDataFrame([], "id long, text string"), texts(1003, 10)
    for size in (8, 100):
        calls.clear()
        (run,) = ran(monkeypatch, lambda: generate(rows, Counting, "text", batch=size))
        made = list(run(iter([batch])))
        assert max(b.num_rows for b in made) <= max(PIECE, size)
        assert calls == [size] * (1003 // size) + [1003 % size]
        assert pa.Table.from_batches(made).column("response").to_pylist() == [x[0] for x in Stub()([t or "" for t in batch.column(1).to_pylist()])]


def test_phase2_sends_no_steps_beside_prompts(spark, monkeypatch):
    sent, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **k: sent.append(self.columns) or plain(self, *a, **k))
    phase2(spark.createDataFrame([], PAIR), CritiqueStub)
    assert len(sent) == 2 and not {"positive_steps", "negative_steps", "positive_answer"} & {c for columns in sent for c in columns}
