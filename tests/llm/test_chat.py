import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm.chat import Renderer, chatml, digests, escape, parse_chatml, segments, unescape

nasty = st.text(alphabet="a<|>\\im_endstar\n é", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(nasty, nasty), max_size=6))
def test_round_trip(turns):
    assert parse_chatml(chatml(turns)) == turns
    r, out = Renderer(chatml, window=4), ""
    for role, text in turns:
        seg, a, z, rewrites = r.add(role, text)
        out += seg
        assert unescape(seg[a:z]) == text and not rewrites
    assert out == chatml(turns)
    assert all(unescape(escape(t)) == t for _, t in turns)


def test_rewritten_history_is_seen():
    last_only = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else '...'};" for i, (r, t) in enumerate(turns))
    r = Renderer(last_only)
    assert [r.add("user", t)[3] for t in ("one", "two")] == [False, True]
    numbered = lambda turns: f"{turns[0][0] if turns else ''}" + "".join(f"<{i}>{t}" for i, (_, t) in enumerate(turns))
    r, out = Renderer(numbered, window=4), ""
    for i in range(40):  # appends only, but other text than a window would give: goes on from the whole prefix
        segment, a, z, rewrites = r.add(str(i), f"t{i}")
        out += segment
        assert segment[a:z] == f"t{i}" and rewrites == (i == 0 and numbered([]) != "")
    assert out == numbered([(str(i), f"t{i}") for i in range(40)])


def test_frames(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "user", "x"), (None, None, "assistant", "\\"), (3, 0, "assistant", "q"), (3, 0, "assistant", "q")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i} <|im_start|>") for i in range(300)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in digests(segments(df)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: tuple((x is not None, x or (0 if i < 2 else "")) for i, x in enumerate(r))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars, g.formatted_chars, g.rewrites) == (len(turns), len(loss), len(chatml(turns)), False)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert digests(segments(df.limit(0))).count() == 0


def test_rewrites_beyond_the_window():
    stripped = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('|')[-1]};" for i, (r, t) in enumerate(turns))
    counted = lambda turns: f"{len(turns)}:" + "".join(f"[{r}]{t};" for r, t in turns)
    for template in (stripped, counted):
        short, whole, longest = Renderer(template, window=8), Renderer(template, window=1 << 30), 0
        for i in range(100):
            turn = ("assistant" if i % 2 else "user", f"thought {i}|answer {i}" if i % 2 else f"question {i}")
            assert short.add(*turn) == whole.add(*turn)
            longest = max(longest, len(short.turns))
        assert longest == (8 if template is stripped else 100)


def test_a_very_long_turn(spark):
    text = "é<|im_end|>\\ " * 300_000
    got = digests(segments(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))).first()
    assert (got.n_turns, got.loss_chars, got.rewrites) == (2, len(text), False)
    assert got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
