"""Lists of children that are matched in arrays: as they are one by one, and as many as can be."""

import random

import pytest

from loglattice.llm import dom, wrapper

from test_wrapper import naive, some_tree


def matched(a, b):
    m = wrapper.Matcher()
    m.know(a)
    m.know(b)
    pairs = list(m.align(a, b))
    number = lambda root: {id(n): k for k, n in enumerate(nodes(root))}
    x, y = number(a), number(b)
    return m.score(a, b), [(x[id(p)], y[id(q)]) for p, q in pairs]


def nodes(root):
    yield root
    for k in wrapper._kids(root) if isinstance(root, dom.Node) else ():
        yield from nodes(k)


@pytest.mark.parametrize("seed", range(20))
def test_results_do_not_depend_on_the_size(seed, monkeypatch):
    r = random.Random(seed)
    a, b = (dom.parse("".join(some_tree(r) for _ in range(r.randrange(2, 9)))) for _ in range(2))
    want = matched(a, b)
    assert want[0] == naive(a, b)
    monkeypatch.setattr(wrapper, "PAIRS", 0)
    monkeypatch.setattr(wrapper, "MEMO", 3, raising=False)
    monkeypatch.setattr(wrapper, "HELD_WEIGHTS", 2, raising=False)
    assert matched(a, b) == want


def test_a_long_list_is_matched_to_the_end():
    # In order, label by label, the list's first <b> would take the other's last one, and nothing else would match.
    items = "".join(f"<p>item {k}</p>" for k in range(1100))
    score, pairs = matched(dom.parse(f"<div><b>x</b>{items}</div>"), dom.parse(f"<div>{items}<b>x</b></div>"))
    assert score == len(pairs) >= 2 * 1100
