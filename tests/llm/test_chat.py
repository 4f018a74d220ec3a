"""Chat formatting: reversible escapes, placeholders, masks, conversations spread over partitions."""

import hashlib
import random

from predio.llm import chat

CONTROLS = ["\\", "###", "### ", ": ", "</turn>", "</turn>\n", "<|", "|>", "<|image 1|>", "\n", "\\</turn>", "é", "日本", "😀", " ", "a", "<", ":"]
SCHEMA = "conv_id long, turn long, role string, text string"


def hostile(rng, n):
    return "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, n)))


def expected(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0)
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        learnt = "".join(t for role, t in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), digest(learnt))
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_digest(df).collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(-3, 60)]:
        for turn in [None, *range(rng.randint(0, 9))]:
            role = rng.choice(["assistant", "assistant", "user", "", None, hostile(rng, 4)])
            rows.append((conv, turn, role, rng.choice([None, hostile(rng, 30)])))
    text = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    # One conversation holds most rows, and one text has some MB.
    rows += [(500, i, rng.choice(["user", "assistant"]), hostile(rng, 12)) for i in range(3000)]
    rows += [(501, 0, "assistant", "".join(hostile(rng, 40) for _ in range(100000)))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    formatted = chat.format_chat(df)
    assert digests(formatted) == expected(rows)
    by_conv = {}
    for r in formatted.orderBy("conv_id", "turn_no").collect():
        so_far = by_conv.setdefault(r["conv_id"], [])
        assert r["turn_no"] == len(so_far) and r["start"] == sum(map(len, so_far))
        so_far.append(r["formatted"])
    chars = {r["conv_id"]: r["formatted_chars"] for r in chat.read_digest(formatted).collect()}
    assert chars == {c: sum(map(len, x)) for c, x in by_conv.items()}


def test_pieces_may_be_cut_anywhere():
    whole = "### user: a\\</turn>b\\\\</turn>\n### as\\: x:: <|image 2|>c\\<|</turn>\n"
    for at in range(len(whole)):
        reader = chat.Reader()
        got = [*reader.feed(whole[:at]), *reader.feed(whole[at:])]
        reader.close()
        assert [g[:2] for g in got] == [("user", "a\\</turn>b\\\\"), ("as: x:", "<|image 2|>c\\<|")]
    assert chat.parse_body("<|image 2|>c\\<|") == [("image", "2"), ("text", "c<|")]
    assert chat.unescape("a\\</turn>b\\\\") == "a</turn>b\\"


def test_typed_parts(spark):
    part = "type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int"
    content = f"array<struct<{part},parts:array<struct<{part}>>>>"
    schema = f"conv_id long, turn long, role string, Content {content}, _conv string, loss string"
    none = (None,) * 6
    inner = [("text", "page <|image 9|>", *none[:5]), ("image", None, "fig.png", 28, 57, None, None)]
    content = [
        ("text", "look: ", *none), ("image", None, "a.png", 56, 56, None, None, None), ("audio", None, "b.wav", None, None, 1.5, None, None),
        None, ("document", None, "c.pdf", None, None, None, 3, inner), ("video", "x", "d.mp4", *none[:5]), ("text", None, *none), (None, "y", *none),
    ]
    rows = [(1, 0, "user", content, "clash", "clash"), (1, 1, "assistant", None, "", ""), (1, 2, "assistant", [("text", "fine", *none)], "", "")]
    got = chat.format_chat(spark.createDataFrame(rows, schema), parts="Content").orderBy("turn_no").collect()
    role, body, _ = next(chat.Reader().feed(got[0]["formatted"]))
    assert role == "user"
    assert chat.parse_body(body) == [
        ("text", "look: "), ("image", "2"), ("audio", "3"), ("document", "4"), ("text", "page <|image 9|>"), ("image", "6"), ("unknown", "7"),
        ("unknown", "9"),
    ]
    found = [(a["part"], a["kind"], a["ref"], a["tokens"]) for a in got[0]["attachments"]]
    assert found[:4] == [(2, "image", "a.png", 4), (3, "audio", "b.wav", 38), (4, "document", "c.pdf", 1536), (6, "image", "fig.png", 3)]
    assert got[0]["expanded_tokens"] == 4 + 38 + 1536 + 3
    assert got[1]["formatted"] == "### assistant: </turn>\n" and got[1]["loss"] == []
    whole = "".join(r["formatted"] for r in got)
    (a, b), = got[2]["loss"]
    assert whole[a:b] == "fine"


def test_empty_table(spark):
    formatted = chat.format_chat(spark.createDataFrame([], SCHEMA))
    assert formatted.count() == 0 and chat.read_digest(formatted).count() == 0
