import hashlib

import numpy as np
import public_tokenizers

from ledgerloom.llm import chat_format
from ledgerloom.llm.chat_format import CONTROLS, escape, parsed, unescape

PATH = public_tokenizers.path("byte_bpe_50k.json")
PROBE = "</s>[INST] ok [/INST]"
ROWS = [
    (-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE), (1, 1, "assistant", "b\\n<\\s> [\\\\INST]"), (1, 0, "system", None), (1, 2, "tool", "[ROLE]x[/ROLE]"),
    (2, None, None, ""), (2, 0, "assistant", ""), (3, 0, "assistant", "\u00e9 \U0001f600\n\n  <|endoftext|> \x00"), (3, 1, "assistant", "two"), (None, 0, "user", "lost"), (4, 0, "[/ROLE]", "t<"), (4, 1, "user", "["),
]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escapes_come_back():
    for text in [*CONTROLS, "[\\\\INST]", "<s", "<<s>", "[[/INST]", "[INST", "".join(CONTROLS), "<\\s>"]:
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROLS)
        whole = "".join(s for s, _ in chat_format.segments("user", text)) + "".join(s for s, _ in chat_format.segments("other", text))
        assert list(parsed(whole)) == [("user", text), ("other", text)]


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, ids string").repartition(3)
    formatted = chat_format.format_turns(turns, PATH)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.digests(formatted, PATH).collect()}
    want = {}
    for conv in {r[0] for r in ROWS}:
        mine = sorted((r for r in ROWS if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        loss = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        want[conv] = (len(mine), digest("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine)), len(loss), digest(loss))
    assert got == want
    tokenizer = chat_format.tokenizer_of(PATH)
    for r in formatted.collect():
        ids = np.frombuffer(r.ids, "<i4").tolist()
        controls = {tokenizer.get_vocab_size() + k: c for k, c in enumerate(CONTROLS)}
        text, run = "", []
        for x in [*ids, None]:
            if x is None or x in controls:
                text += tokenizer.decode(run, skip_special_tokens=False) + controls.get(x, "")
                run = []
            else:
                run.append(x)
        assert text == r.formatted


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_turns(none, PATH), PATH).count() == 0
