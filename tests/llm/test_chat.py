import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from paneltide.llm import prefix_chat as C


@given(st.lists(st.tuples(st.text(alphabet="<|>\\turnexd/ \né", max_size=12), st.text(alphabet="<|>\\turnexd/ \né", max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_parse_inverts_the_template(turns):
    text = "".join(f"{C.TURN}{C.escape(r)}{C.TEXT}{C.escape(t)}{C.END}" for r, t in turns)
    assert C.parse(text) == turns


ROWS = [
    (1, 0, "system", "be\\nice", 0), (1, 1, "user", "<|turn|>user<|text|>x<|end|>", 0), (1, 2, "assistant", "a<|end|>\\", 0), (1, 3, "user", None, 0), (1, 4, "assistant", None, 0),
    (1, 5, "user", "bye", 0), (2, 0, "user", "alone", 0), (3, 0, "assistant", "first", 0), (3, 0, "assistant", "first", 0), (3, None, None, "null turn", 0),
    (None, 1, "assistant", "no id", 0), (4, 7, "assistant", "é😀" * 50_000, 0),
]


def plain():
    out = {}
    for cid in {r[0] for r in ROWS}:
        turns = sorted((r for r in ROWS if r[0] == cid), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        blocks = ["<|turn|>" + C.escape(r) + "<|text|>" + C.escape(t) + "<|end|>" for r, t in turns]
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        if not ends or ends[-1] != len(turns) - 1:
            ends.append(len(turns) - 1)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[cid] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(blocks[:e + 1])) for e in ends))
    return out


def test_read_back_digests(spark, monkeypatch):
    monkeypatch.setattr(C, "FLUSH_CHARS", 200)
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, example int")
    made = C.examples(df)
    for got in (C.read_back(made, in_order=True), C.read_back(made)):
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain()


def test_only_the_reply_is_trainable(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, example int")
    made = {(r.conv_id, r.example): r for r in C.examples(df).collect()}
    r = made[1, 0]
    assert C.unescape(r.formatted[r.loss_start:r.loss_end]) == "a<|end|>\\" and r.formatted.endswith(C.END)
    assert made[1, 1].formatted.startswith(r.formatted)      # all preceding turns are context
    assert made[1, 2].loss_start is None and made[2, 0].loss_start is None
    assert C.examples(df.limit(0)).count() == 0 and C.read_back(C.examples(df.limit(0)), True).count() == 0
