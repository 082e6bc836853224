"""Chat formatting: the digests against ones worked out from the table, and very long turns."""

import hashlib
import random

from grantscope.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["ok", "</s>", "[INST] ", " [/INST]", "<<SYS>>", "<</SYS>>", "[ROLE a]", "[/ROLE]", "\\", "\\b", "[", "<", "é😀", "\n", "<s>", "[ANS] ", ""]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 9)):
            text = None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 6)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "a b", "x]"]), text))
    want = {}
    for conv, _, role, text in sorted([*rows, (-7, 0, "user", chat.HOSTILE[1]), (-7, 1, "assistant", chat.HOSTILE[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        n, turns, loss = want.get(conv, (0, "", ""))
        want[conv] = (n + 1, turns + f"{role}\n{text or ''}\n", loss + (text or "") * (role == "assistant"))
    got = chat.query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: (n, sha(t), len(x), sha(x)) for c, (n, t, x) in want.items()}
    whole = {r.conv_id: r.formatted_chars for r in got}
    assert all(whole[c] >= len(t) - n for c, (n, t, _) in want.items())


def test_very_long_turns(spark):
    texts = ["[/INST]" * 50_000, "x" * 1_000_000, "\\<[" * 100_000]
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant", "user"], texts))]
    r = chat.query(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("conv_id = 1").first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (3, 1_000_000, sha(texts[1]))
    assert r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in rows))
