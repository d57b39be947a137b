"""Hostile pages take time in proportion to their size, and the cut is least by brute force."""

import itertools
import random
import time

import numpy as np
import pytest

from tidewater.llm import mincut

HOSTILE = {
    "nested": "<div>x" * 100_000, "unended": "<a " * 200_000, "quotes": '<p x="' * 100_000, "ended": "<a " * 200_000 + ">", "ended quotes": '<p x="' * 100_000 + ">",
    "end tags of others": "<div>" * 50_000 + "</section>" * 50_000, "inline": "<b class=ad><div>" + "<span class=ad>" * 40_000 + "</b>" * 40_000, "comments": "<!-- " * 100_000, "brackets": "< " * 200_000, "scripts": "<script>" * 50_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages(kind):
    began = time.process_time()
    mincut.main_text(HOSTILE[kind], mincut.Model(np.ones(mincut.N_FEATURES)))
    assert time.process_time() - began < 20


def cost(labels, gain, edges):
    own = sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gain, labels))
    return own + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cut_is_least():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 9)
        gain = [rng.choice([rng.uniform(-2, 2), 0.5, -0.5, 0.0]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.0, 0.3, 0.6, rng.random()])) for _ in range(rng.randint(0, 2 * n))]
        best = min(cost(x, gain, edges) for x in itertools.product((True, False), repeat=n))
        assert abs(cost(mincut.minimum_cut(gain, edges), gain, edges) - best) < 1e-9


def test_cut_of_a_long_page():
    rng = random.Random(7)
    n = 30_000
    gain = [rng.uniform(-1.2, 1.2) for _ in range(n)]
    edges = [(k - 1, k, w) for w in (0.3, 0.5) for k in range(1, n)]
    began = time.process_time()
    labels = mincut.minimum_cut(gain, edges)
    assert time.process_time() - began < 20
    # A chain's least cut by dynamic programming.
    best = [max(-gain[0], 0), max(gain[0], 0)]  # the cost so far with the last block content, or not
    for g in gain[1:]:
        best = [min(best[0], best[1] + 0.8) + max(-g, 0), min(best[1], best[0] + 0.8) + max(g, 0)]
    assert abs(cost(labels, gain, edges) - min(best)) < 1e-6


def test_blocks_know_their_distance():
    blocks = mincut.blocks_of("<div><p>a</p><p>b</p></div><ul><li>c<ul><li>d</ul></ul>e")
    assert [(b.text, b.tag, b.apart) for b in blocks] == [("a", "p", 2), ("b", "p", 2), ("c", "li", 4), ("d", "li", 2), ("e", "", 4)]
    assert blocks[0].parent == blocks[1].parent != blocks[2].parent


def made_pages(rng, n, wrong):
    """(page, content of its blocks) of pages in which a share of paragraphs has no tag of its own or a wrong name."""
    out = []
    for _ in range(n):
        sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(12, 30))) + "."
        name = lambda: ' class="promo"' if rng.random() < wrong else ""
        body = "".join(f"<{t}{name()}>{sentence()}</{t}>" for t in (rng.choice(["p", "p", "div"]) for _ in range(8)))
        menu = "".join(f"<li><a href=x>{sentence()[:9]}</a></li>" for _ in range(6))
        out.append((f"<nav><ul>{menu}</ul></nav><article>{body}</article><footer><div>me</div></footer>", [False] * 6 + [True] * 8 + [False]))
    return out


def learned(pages):
    xs, es, pairs = [], [], np.zeros((mincut.FAR + 2, 2))
    for page, _ in pages:
        blocks = mincut.blocks_of(page)
        named = [b for b in blocks if b.evidence]
        xs.append(mincut.features(named))
        es += [b.evidence for b in named]
        for a, b, d in mincut.neighbours(blocks):
            if blocks[a].evidence and blocks[b].evidence:
                pairs[mincut.FAR + 1 if d is None else d, int((blocks[a].evidence > 0) == (blocks[b].evidence > 0))] += 1
    return mincut.fit(np.vstack(xs), np.array(es), pairs)


def test_cut_mends_wrong_names():
    pages = made_pages(random.Random(9), 200, 0.2)
    model, right = learned(pages), [0, 0]
    assert model.word < 0.7 * mincut.MOST_WORD < mincut.MOST_TAG == pytest.approx(model.tag, rel=0.2)
    for page, want in pages:
        blocks = mincut.blocks_of(page)
        gains = mincut.gains(blocks, model).tolist()
        for k, labels in enumerate((mincut.minimum_cut(gains, mincut.edges_of(blocks, model)), [g > 0 for g in gains])):
            right[k] += sum(x == y for x, y in zip(labels, want))
    total = sum(len(w) for _, w in pages)
    assert right[0] >= right[1] and right[0] > 0.99 * total


def test_nothing_to_learn_from():
    none = mincut.fit(np.zeros((0, mincut.N_FEATURES)), np.zeros(0), np.zeros((mincut.FAR + 2, 2)))
    assert (none.tag, none.word, none.sibling) == (mincut.MOST_TAG, mincut.MOST_WORD, mincut.SIBLING)
    page = "<div><div><a href=x>Home</a></div><p>A paragraph of some length, which reads like a text and ends with a full stop.</p><p hidden>A paragraph that nobody sees, of some length too, and it ends as well.</p></div>"
    assert mincut.main_text(page, none) == "A paragraph of some length, which reads like a text and ends with a full stop."
