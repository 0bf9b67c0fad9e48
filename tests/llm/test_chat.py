import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from fieldscope.llm import chat
from llm import cases

MARKS = ["<", "[", "/", "\\", "s>", "INST]", "ROLE]", "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", " ", "\n", "a", ""]
texts = st.lists(st.sampled_from(MARKS), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), texts)


@given(texts)
def test_escapes_are_undone_and_hide_every_mark(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(m in safe for m in MARKS[7:13])


@settings(max_examples=200)
@given(st.lists(st.tuples(roles, texts), min_size=1, max_size=6))
def test_turns_are_read_back_and_found(turns):
    found = chat.Prefixes(chat.marked)
    for turn in turns:
        found.add(*turn)
    text, starts, stops, n = found.take(last=True)
    assert text == chat.marked(turns) and list(chat.parse(text)) == turns and n == len(turns) and not found.rewrites
    assert [chat.unescape(text[a:b]) for a, b in zip(starts, stops)] == [t for r, t in turns if r == "assistant"]


def test_long_conversations_render_short_windows():
    sizes = []

    def template(turns):
        sizes.append(len(turns))
        return chat.marked(turns)

    turns = [("user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(400)]
    found = chat.Prefixes(template)
    for turn in turns:
        found.add(*turn)
    text, starts, stops, _ = found.take(last=True)
    assert text == chat.marked(turns) and max(sizes) <= chat.WINDOW
    assert [chat.unescape(text[a:b]) for a, b in zip(starts, stops)] == [t for r, t in turns if r == "assistant"]


def numbered(turns):
    return "".join(f"{i}:{role}:{text};" for i, (role, text) in enumerate(turns))


def test_a_template_that_looks_back_gets_whole_prefixes():
    turns = [("assistant", f"t{i}") for i in range(60)]
    found = chat.Prefixes(numbered)
    for turn in turns:
        found.add(*turn)
    text, starts, stops, _ = found.take(last=True)
    assert text == numbered(turns) and not found.local and not found.rewrites
    assert [text[a:b] for a, b in zip(starts, stops)] == [t for _, t in turns]


def closed(turns):
    """An end mark after the last turn only."""
    return "".join(f"<{role}>{text}" for role, text in turns) + "<end>"


def forgetful(turns):
    """Thoughts of all but the last turn are left out."""
    return "".join(f"<{role}>{text if at == len(turns) - 1 else text.rpartition('|')[2]}." for at, (role, text) in enumerate(turns))


def moving(turns):
    """What the system says stands before the last question."""
    said = "".join(t for r, t in turns if r == "system")
    asked = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return "".join(f"<{role}>{said if at == asked else ''}{text}." for at, (role, text) in enumerate(turns) if role != "system")


TALK = [("system", "S"), ("user", "u1"), ("assistant", "thought|a1"), ("user", "u2"), ("assistant", "a2"), ("user", "u3")]


@pytest.mark.parametrize("template, learned", [
    (closed, ["thought|a1", "a2"]), (forgetful, ["a1", "a2"]), (moving, ["thought|a1", "a2"])])
def test_templates_that_rewrite_history_are_found_out(template, learned):
    found = chat.Prefixes(template)
    for turn in TALK:
        found.add(*turn)
    text, starts, stops, n = found.take(last=True)
    assert found.rewrites and found.rewritten and text == template(TALK) and n == len(TALK)
    assert [text[a:b] for a, b in zip(starts, stops)] == learned


def test_a_text_that_the_template_hides_is_not_learned():
    found = chat.Prefixes(lambda turns: "".join(f"[{role}]" for role, _ in turns))
    found.add("assistant", "x")
    assert found.take(last=True) == ("[assistant]", [], [], 1)


LONG = [(7, i, "user" if i % 2 else "assistant", f"{i} " + "long [/INST] text " * 3000) for i in range(90)]
ROWS = [(1, 0, "system", "be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "<s>\\</s>"), (2, None, "user", None),
        (2, 0, None, "no role"), (2, 0, None, "no role"), (2, 0, "user", None), (None, 5, "assistant", "lost"), (None, 4, "user", "é\U0001F600"),
        (3, 1, "assistant", " "), (3, 0, "tool [/ROLE]", "\r\n\x00"), (-1, 1, "assistant", "more"), (4, 0, "user", "w " * 600_000), *LONG]


def conversations(spark, rows):
    made = [(*r, *["x"] * len(cases.CLASHING)) for r in rows]
    return spark.createDataFrame(made, "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in cases.CLASHING))


def expected(rows):
    groups = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", chat.HOSTILE), (-1, 1, "assistant", chat.HOSTILE)]:
        groups.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    found = []
    for conv, turns in groups.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        found.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                      len(chat.marked(turns))))
    return sorted(found, key=str)


def test_query_reads_back_every_turn(spark, tmp_path):
    folder = cases.saved(conversations(spark, ROWS), tmp_path, "conversations")
    made = chat.op12_chat_format(spark, folder)
    assert made.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, made.collect()), key=str) == expected(ROWS)


def test_long_conversations_take_several_rows(spark):
    rows = chat.formatted(conversations(spark, LONG)).collect()
    assert len(rows) > 2 and [r.part for r in rows] == list(range(len(rows))) and [r.last for r in rows].index(True) == len(rows) - 1
    assert "".join(r.text for r in rows) == chat.marked([(r, t) for _, _, r, t in LONG])


def test_no_conversations(spark, tmp_path):
    folder = cases.saved(conversations(spark, []), tmp_path, "conversations")
    assert sorted(map(tuple, chat.op12_chat_format(spark, folder).collect()), key=str) == expected([])
