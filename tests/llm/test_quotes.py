from lonja.llm import quotes as L

ROWS = "conv_id long, turn long, role string, text string"


def links(frame, rows):
    out = L.link_quotes(frame(rows, ROWS, ("own", "level", "hash"))).collect()
    assert len(out) == len(rows)
    return {(r.conv_id, r.turn): r for r in out}


def test_nested_quotes_and_threads(frame):
    r = links(frame, [
        (1, 0, "a", "Hello there\nSecond line"), (1, 1, "b", "> hello   THERE\n> Second line\nMy answer"), (1, 2, "a", "> > Hello there\n> > second line\n> My answer\n\nThanks"),
        (1, 3, "c", ">> My answer\n> Thanks\n> \nok"), (2, 0, "d", "> Second line\nquoting one line"), (2, 1, "e", "> never said\nhm"), (2, 2, "e", "no quotes")])
    parent = {k: (v.parent_conv, v.parent_turn) for k, v in r.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 2), (2, 0): (1, 0), (2, 1): (None, None), (2, 2): (None, None)}
    assert {k: v.depth for k, v in r.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 0): 1, (2, 1): 0, (2, 2): 0}
    assert (r[1, 3].thread_conv, r[1, 3].thread_turn) == (1, 0)
    assert (r[1, 2].n_quotes, r[1, 2].n_linked, r[1, 2].max_level, r[1, 2].own) == (2, 2, 2, "Thanks")
    assert (r[2, 1].n_quotes, r[2, 1].n_linked) == (1, 0) and r[2, 0].own == "quoting one line"


def test_shared_texts_stay_in_their_conversation(frame):
    rows = [x for c in range(40) for x in ((c, 0, "u", "the same start"), (c, 1, "v", "> the same start\nreply"))]
    assert all((r.parent_conv, r.parent_turn, r.thread_conv) == (r.conv_id, 0, r.conv_id) for (_, t), r in links(frame, rows).items() if t)


def test_no_cycles_and_long_chains(frame):
    r = links(frame, [(1, 0, "a", "> b says\na says"), (2, 0, "b", "> a says\nb says")])
    assert r[1, 0].parent_conv is None and (r[2, 0].parent_conv, r[2, 0].parent_turn) == (1, 0)
    chain = links(frame, [(5, k, "x", (f"> text {k - 1}\n" if k else "") + f"text {k}") for k in range(70)])
    assert {k: v.depth for (_, k), v in chain.items()} == {k: k for k in range(70)}


def test_nulls_repeats_and_blank_quotes(frame):
    out = L.link_quotes(frame([(1, 0, None, None), (1, 1, "a", ""), (1, 2, "a", "> \n>\nx"), (None, 0, "a", "> x"), (1, None, "b", "> x"), (1, 3, "c", "> x\ny"), (1, 3, "c", "> x\ny"), (1, 4, "d", ">" * 5000 + " x")], ROWS)).collect()
    assert len(out) == 8
    assert sorted((r.turn, r.parent_turn, r.n_quotes) for r in out if r.conv_id == 1 and r.turn is not None) == [(0, None, 0), (1, None, 0), (2, None, 0), (3, 2, 1), (3, 2, 1), (4, 2, 1)]
    assert L.link_quotes(frame([], ROWS)).collect() == []


def test_main_path_is_native(frame):
    df = L.link_quotes(L.as_mail(frame([(1, 0, "a", "x"), (1, 1, "b", "y")], ROWS)))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert {(r.turn, r.parent_turn) for r in df.collect()} == {(0, None), (1, 0)}
