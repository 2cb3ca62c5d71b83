"""Tokens, containers, look-alike forms and markup: exact references, round trips, dirty rows."""

import base64
import random
import unicodedata
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import bpe, lookalike, markup, packing

PATH = bpe.vocabulary_path()

# --- tokens -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_reference_encoder(text):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)} if not _REF else None
    if not _REF:
        _REF.append(tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert bpe.encoder(PATH).encode(text) == _REF[0].encode_ordinary(text)


_REF: list = []


@pytest.mark.parametrize("text", ["", "<|endoftext|> x", "a" * 20_000, "ab" * 9_000, "-=" * 8_000, " " * 9_000 + "x", "é" * 5_000, "日本語の長い文章" * 600, "a\x00b\x1c\x85\u2028", "👩\u200d🔬" * 50])
def test_long_and_odd_texts(reference, text):
    ids = bpe.encoder(PATH).encode(text)
    assert ids == reference.encode_ordinary(text)
    decoder = bpe.Decoder(PATH)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], final=True) == text


def test_token_columns(spark, rows):
    df = spark.createDataFrame([(1, "the cat", 5), (2, None, 5), (3, "", 5), (1, "the cat", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    got = rows(bpe.encode_column(df, "doc_id"))
    assert [r[1] for r in got] == [[87], [1169, 3797], [1169, 3797], [], []]
    assert rows(bpe.count_column(df, "doc_id")) == [(None, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode_column(df.limit(0), "doc_id").count() == 0


def test_small_vocabulary_is_forgotten_not_broken(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 3)
    enc = bpe.Encoder(PATH)
    text = " ".join(f"word{i}" for i in range(50))
    assert enc.encode(text) == bpe.encoder(PATH).encode(text) and len(enc.kept) <= 3


# --- containers -------------------------------------------------------------------------------


def best_fit(sizes, capacity):
    """Brute force: best-fit decreasing, one document at a time; number of containers."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps.remove(fit)
            gaps.append(fit - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_equals_best_fit_decreasing(sizes):
    runs, n = packing.best_fit_plan(Counter(sizes), 40)
    used, ranks = Counter(), set()
    for size, rank, count, first in runs.tolist():
        for i in range(count):
            used[first + i] += size
            ranks.add((size, rank + i))
    assert n == best_fit(sizes, 40) == len(used) and all(u <= 40 for u in used.values())
    assert len(ranks) == len(sizes)


def test_containers_hold_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 60)
    rng = random.Random(2)
    sizes = [(i, rng.choice([0, 7, 7, 7, 2048, 2049, 5000, rng.randint(1, 2000)]), "x") for i in range(300)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long, q_b string").drop("q_b")
    got = packing.pack(df, "doc_id").collect()
    used, seen = Counter(), {}
    for r in got:
        used[r.container] += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert max(used.values()) <= 2048 and set(seen) == {i for i, n, _ in sizes if n}
    for i, n, _ in sizes:
        at = 0
        for start, size in sorted(seen.get(i, [])):
            assert start == at and (n <= 2048) == (size == n)
            at += size
        assert at == n
    packed = packing.contents(packing.pack(df, "doc_id"), "doc_id").collect()
    assert sum(r.n_docs for r in packed) == len(got) and all(r.used == sum(x.n_tokens for x in r.docs) for r in packed)


def test_containers_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long"), "doc_id").count() == 0


# --- look-alike forms -------------------------------------------------------------------------

SAME = [
    ("file", "ﬁle"), ("Kappa", "Ｋａｐｐａ"), ("café", "cafe\u0301"), ("a b", "a\u00a0b"), ("a b", "a\u3000b"), ("ab", "a\u200bb"), ("ab", "a\ufeff\u00adb\ufe0e"),
    ("scope", "ѕсоре"), ("Ath", "Аth"), ("a-b", "a‐b"), ("a-b", "a‑b"), ("バナナ", "ﾊﾞﾅﾅ"), ("liv", "ⅼiv"), ("gag", "ɡɑɡ"), ("ệ", "e\u0302\u0323"), ("Kelvin", "\u212aelvin"), ("5.", "５．"),
    ("ab", "a\u200db"), ("Åb", "\u212bb"), ("한", "\u1112\u1161\u11ab"),
]
OTHER = [("a", "A"), ("x2", "x²"), ("cafe", "café"), ("a.", "a!"), ("a b", "a  b"), ("a b", "ab"), ("m", "rn"), ("👩\u200d🔬", "👩🔬"), ("1", "l"), ("ß", "ss"), ("æ", "ae"), ("a\nb", "a b"), ("½", "1/2")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_to_a_reader(a, b):
    one, two = lookalike.canonical_texts([a, b])
    assert one == two and lookalike.canonical_texts([one]) == [one] and unicodedata.normalize("NFC", one) == one


@pytest.mark.parametrize("a, b", OTHER)
def test_different_to_a_reader(a, b):
    one, two = lookalike.canonical_texts([a, b])
    assert one != two


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="ae\u0301\u0323\u0308\u200d\u0327ﬁ👩🔬\u1112\u1161\u11abﾊﾞ ", max_size=12)), max_size=8))
def test_forms_of_a_batch(texts):
    forms = lookalike.canonical_texts(texts)
    assert forms == [lookalike.canonical_texts([t])[0] for t in texts]
    assert lookalike.canonical_texts(forms) == forms
    assert lookalike.canonical_texts([t and unicodedata.normalize("NFD", t) for t in texts]) == lookalike.canonical_texts([t and unicodedata.normalize("NFC", t) for t in texts])


def test_pairs_skip_copies_and_blanks(spark, rows):
    data = [(1, "file one"), (2, "ﬁle one"), (3, "file one"), (4, None), (5, ""), (6, " "), (7, "\u00a0"), (8, "File one"), (2, "ﬁle one"), (9, "copy"), (10, "copy"), (None, "ﬁle one")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("own", F.lit(2))
    assert rows(lookalike.same_to_a_reader(df, "doc_id")) == [(1, 2), (2, 3)]
    assert lookalike.same_to_a_reader(df.limit(0), "doc_id").count() == 0
    forms = dict(rows(lookalike.canonical_column(df.where("doc_id in (2, 4, 5)").distinct(), "doc_id")))
    assert forms == {2: "file one", 4: None, 5: ""}


# --- markup -----------------------------------------------------------------------------------

PLAIN = [
    "It only holds while a < b and c > 3.", "x<y && y>5865", "I <3 this", "a Vec<f32> of", "Pass <your dim> as", "costs $5 and the big one $10 more", "rows[0][14] fails", "3 * 4 * 5 pages",
    "read_next_page and max_walk_depth", "C:\\temp\\new\\run4", "12 == 12, always", "i++ ran twice :-)", "a|b as either", "client <- reader -> merger", "{x, y, 9}", "About ~70 of", "Q&A page", "C# and F#",
    "issue #4828 again", "2.6^2 is not", "<= 5 or >= 8599", "at k = 50!", "f(*args, **kwargs)", "__init__ and _x", "a**b + c**d", "AT&T; and R&D", "-5 degrees", "HashMap<String, Vec<u8>>", "", "5 > 3",
]
MARKED = {
    "tag": "one<BR/>two", "comment": "a <!-- x --> b", "entity": "a&#160;b", "fence": "```\ncode\n```", "code": "run `make all` now", "atx": "## Head\n\nx", "setext": "Head\n====\nx", "item": "x\n\n- one", "numbered": "1. one",
    "quote": "> said", "table": "| a | b |\n|---|---|\n| 1 | 2 |", "strong": "so **very** good", "em": "so *very good* it", "under_em": "so _very good_ it", "under_strong": "so __very__ it", "triple": "so ***very*** it", "strike": "~~no~~ yes",
    "link": "[t](http://x.y/z)", "ref_link": "see [the log][1]", "ref_def": '[1]: https://x.y "log"', "autolink": "<https://x.y>", "wiki_heading": "== Head ==", "quotes": "so ''very'' it", "wiki_link": "see [[Page|it]]",
    "ext_link": "[https://x.y the thread]", "template": "{{note|a|k=1}}", "wiki_table": '{| class="t"\n|-\n| 1 || 2\n|}', "environment": "\\begin{itemize}\n\\item x\n\\end{itemize}", "command": "\\emph{so} on", "bare": "\\item x",
    "paren_math": "with \\(k \\le 2\\) it", "bracket_math": "\\[ x = 1 \\]", "display_math": "$$x$$", "dollar_math": "So $d^2 = 4$ here",
}


@pytest.mark.parametrize("text", PLAIN)
def test_running_text_is_no_markup(text):
    assert list(markup.constructs(text)) == [] and markup.clean_text(text) == text


@pytest.mark.parametrize("rule", MARKED)
def test_constructs_are_found(spark, rule):
    assert rule in set(markup.constructs(MARKED[rule]))


def test_filter_in_the_jvm_passes_every_construct(spark):
    df = spark.createDataFrame([(k, v) for k, v in MARKED.items()], "k string, t string")
    assert df.where(~markup.maybe_markup("t")).collect() == []


@pytest.mark.parametrize(
    "raw, want",
    [
        ("<h2>Head</h2>one<p>two &lt; three", "## Head\n\none\n\ntwo < three"),
        ('<ol start="4"><li>a<li>b</ol>c', "4. a\n5. b\nc"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n\n- b"),
        ("<pre><code>if a &lt; b:\n    *x*</code></pre>", "```\nif a < b:\n    *x*\n```"),
        ("A\n===\n\n* **one** [t](http://x) `c_d_e`", "# A\n\n- one t c_d_e"),
        ("| a | b |\n|---|:-:|\n| 1 | 2 |", "a | b\n\n1 | 2"),
        ("== H ==\n'''b''' [[X|y]] [http://z w] {{t|u}}", "## H\nb y w"),
        ('{| class="t"\n! k !! r\n|-\n| 1 || 2\n|}', "k | r\n1 | 2"),
        ("\\section{H}\n\\begin{itemize}\n\\item \\emph{a}\n\\end{itemize}\nin table~\\ref{t:1}, \\(x_1\\)", "## H\n\n- a\n\nin table, $x_1$"),
        ("<script>var t = 1;</script>x<!-- y -->", "x"),
        ("see [the log][1]\n\n[1]: https://x.y/z \"log\"", "see the log"),
        (None, None),
        ("", ""),
    ],
)
def test_clean_text(raw, want):
    assert markup.clean_text(raw) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>&;#*_`[](){}|$\\=-~'\n1.:/!", max_size=60))
def test_cleaning_never_breaks(text):
    out = markup.clean_text(text)
    assert isinstance(out, str) and (markup.has_markup(text) or out == text)


def test_very_long_texts_take_linear_time():
    import time

    for unit in ("*a ", "_a ", "[a", "<a ", "{{a|", "`a ", "$a ", "\\a", "''a ", "- a\n", "a\n", "&a", "**a", "|-|"):
        t = time.time()
        markup.has_markup(unit * (60_000 // len(unit)))
        assert time.time() - t < 5, unit


def test_markup_columns(spark, rows):
    df = spark.createDataFrame([(1, "<b>x</b>"), (1, "<b>x</b>"), (2, "plain"), (3, None), (4, ""), (None, "<b>y</b>")], "id long, text string").withColumn("q_text", F.lit(0))
    assert rows(markup.marked_up(df, "id", "text")) == [(1,)]
    assert rows(markup.clean_column(df, "id", "text")) == [(None, "y"), (1, "x"), (1, "x"), (2, "plain"), (3, None), (4, "")]
    assert markup.marked_up(df.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize(
    "raw, want",
    [
        ("*" + "long word " * 90 + "end*", "long word " * 90 + "end"),
        ("''" + "long word " * 300 + "end''", "long word " * 300 + "end"),
        ("see *soft\nwrapped* text", "see soft\nwrapped text"),
        ("see **soft\nwrapped** text", "see soft\nwrapped text"),
        ("see __soft\nwrapped__ and", "see soft\nwrapped and"),
        ("see _soft\nwrapped_ and", "see soft\nwrapped and"),
        ("see ~~soft\nwrapped~~ text", "see soft\nwrapped text"),
        ("see `soft\nwrapped` text", "see soft\nwrapped text"),
        ("see [soft\nwrapped](http://x.y/z) text", "see soft\nwrapped text"),
        ("**a *b* c**", "a b c"),
        ("x " + "{{a|" * 7 + "b" + "}}" * 7 + " y", "x  y"),
        ("x " + r"\textbf{" * 9 + "b" + "}" * 9 + " y", "x b y"),
    ],
)
def test_long_wrapped_and_nested_constructs(raw, want):
    assert markup.has_markup(raw) and markup.clean_text(raw) == want


@pytest.mark.parametrize("text", ["2 *3\n\nand 4* 5", "a ~~b\n\nc~~ d", "a `b\n\nc` d"])
def test_spans_end_with_their_paragraph(text):
    assert not markup.has_markup(text)


def test_held_pieces_within_held_pieces_are_released():
    h = markup._Holder()
    at = "x"
    for i in range(9):
        at = h.hold(f"{i}{at}")
    assert h.release(at) == "876543210x"


@pytest.mark.parametrize("pair", ["ӕæ", "ӔÆ", "әə", "ӘƏ", "ÐĐ", "ƉĐ"])
def test_letters_drawn_alike_fold_together(pair):
    assert lookalike.fold(pair[0]) == lookalike.fold(pair[1])
