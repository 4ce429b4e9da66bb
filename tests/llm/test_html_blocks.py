import numpy as np
import pytest

from cutline.llm import html_blocks as hb
from cutline.llm.html_blocks import blocks

PAGE = (
    "<html><body><nav><ul><li><a href=/a>News {0}</a><li><a href=/b>About</a></ul></nav><div class='ad'>Buy {0} now.</div><article><h1>Head {0}"
    "</h1><p>First {0} paragraph of the text, it is long.<p>Second &amp; last, with <b>b</b>old words.</article><footer>&copy; {0}</footer>"
)


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts(PAGE.format("x")) == [
        "News x", "About", "Buy x now.", "Head x", "First x paragraph of the text, it is long.", "Second & last, with bold words.", "© x",
    ]
    assert blocks("<div><p>a<p>b")[1].path == ("div", "p")
    assert texts("a<!-- b --><script>var t='</p><p>c'</script>d<style>p{}</style> <title>t</title>\n e") == ["ad e"]
    assert texts("<p title='a > b'>x</p> 1 < 2 <p class=c>y") == ["x", "1 < 2", "y"]
    assert texts("<table><tr><td>a<td>b</table>&#8364;&nbsp;&lt;p&gt;") == ["a", "b", "€ <p>"]
    assert texts("") == texts("<p></p> <br>") == texts("<!-- open") == []


@pytest.mark.parametrize("page", ["<!--" * 60_000, "<p " * 60_000, "<script>" * 40_000, "<a href='" * 40_000, "<b>" * 50_000, "&" * 90_000])
def test_broken_pages_take_linear_time(page):
    blocks(page)


def test_gradients():
    rng = np.random.default_rng(1)
    network = hb.Network.new()
    pages = [hb.inputs(blocks(PAGE.format(x))) for x in ("one", "two")]
    pages[1] = tuple(part[:4] for part in pages[1])
    labels = [np.array([0, 0, 0, 1, 1, 1, 0.0]), np.array([0, 0, 0, 1.0])]
    _, gradients = network.step(pages, labels)
    for name, values in network.parameters.items():
        flat, slope = values.reshape(-1), gradients[name].reshape(-1)
        for at in rng.permutation(np.flatnonzero(slope))[:4]:
            kept = flat[at]
            sides = []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                sides.append(network.step(pages, labels)[0])
            flat[at] = kept
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(slope[at], rel=1e-3, abs=1e-7), name


@pytest.fixture(scope="module")
def network():
    return hb.train([PAGE.format(f"w{i}") for i in range(150)], passes=8)


def test_held_out_pages_in_other_markup(network):
    page = (
        "<body><div class=menu><a href=/>Start</a></div><div class='post content'><h2>A title</h2><p>Some text that says a lot, in words.</p>"
        "<p>More of it, in other words.</p></div><div id=comments><p>I liked this.</p></div><div class=footer>Imprint</div>"
    )
    found = blocks(page)
    labels = network.label([hb.inputs(found)])[0] >= 0.5
    assert labels.tolist() == [False, True, True, True, False, False]


def test_inputs_hold_whole_paths_and_the_words_of_long_blocks():
    deep = "<aside>" + "<div class='c1'>" * 30 + "<p>" + "long words of one block, again. " * 40
    (paths, words, _), (shallow, short, _) = hb.inputs(blocks(deep)), hb.inputs(blocks("<aside><div class=c1><p>again block long of one words"))
    assert set(paths[0]) == set(shallow[0]) and set(words[0]) == set(short[0])


@pytest.mark.parametrize("depth", [0, 14])
@pytest.mark.parametrize("length", [100, 700])
def test_long_and_deep_rest_is_left_out(network, depth, length):
    said = "".join(f"I think that w{i} says a lot, in words. " for i in range(length))[:length]
    rest = "".join(f"<{e}>{'<div>' * depth}<p>{said}</p>{'</div>' * depth}</{e.split()[0]}>" for e in ("section id=comments", "aside", "div class=ad"))
    found = blocks(f"<body><article><h1>A title</h1><p>{said}</p></article>{rest}<footer>Imprint</footer>")
    assert (network.label([hb.inputs(found)])[0] >= 0.5).tolist() == [True, True, False, False, False, False]


def test_labels_are_those_of_a_block_by_block_recurrence(network):
    """Every gate of every block computed one at a time, in pages of different lengths."""
    pages = [hb.inputs(blocks(PAGE.format(x) * n)) for x, n in (("a", 1), ("b", 3))]
    p = network.parameters
    for (paths, words, measures), labels in zip(pages, network.label(pages)):
        rows = [
            np.concatenate([*(sum(p["vectors"][i] for i in bag) / len(bag) ** 0.5 for bag in (path, word)), m])
            for path, word, m in zip(paths, words, measures)
        ]
        states = {}
        for way, order in (("right", range(len(rows))), ("left", reversed(range(len(rows))))):
            hidden = cell = np.zeros(hb.STATE)
            for at in order:
                gates = rows[at] @ p[f"in_{way}"] + hidden @ p[f"state_{way}"] + p[f"bias_{way}"]
                into, forget, out = (1 / (1 + np.exp(-gates[k * hb.STATE : (k + 1) * hb.STATE])) for k in range(3))
                cell = forget * cell + into * np.tanh(gates[3 * hb.STATE :])
                hidden = out * np.tanh(cell)
                states[way, at] = hidden
        for at, label in enumerate(labels):
            drive = np.concatenate([states["right", at], states["left", at]]) @ p["out"] + p["bias"][0]
            assert label == pytest.approx(1 / (1 + np.exp(-drive)), abs=1e-9)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(i, "u", PAGE.format(i), "clash", 1) for i in range(40)] + [(50, None, None, None, None), (None, "u", "", "", 1), (1, "u", PAGE.format(1), "", 1)]
    rows += [(60, "u", "<article>" + "<p>Words and words, again.</p>" * 5_000 + "</article>", "", 1)]
    pages = spark.createDataFrame(rows, schema)
    found = hb.extract(pages, hb.fitted(pages, 30)).collect()
    assert len(found) == len(rows)
    by_id = {r["page_id"]: r for r in found}
    assert by_id[3]["text"] == "Head 3 First 3 paragraph of the text, it is long. Second & last, with bold words."
    assert by_id[50]["text"] == by_id[None]["text"] == "" and by_id[50]["n_chars"] == 0
    assert by_id[60]["n_chars"] == len(by_id[60]["text"]) == 5_000 * 24 - 1
    empty = spark.createDataFrame([], schema)
    assert hb.extract(empty, hb.fitted(empty)).count() == 0
