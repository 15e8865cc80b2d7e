from __future__ import annotations

import functools
import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from commerce_spark.llm import htmltext, queries, sentencepiece_bpe, sstable, suffixdedup

MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codecs():
    return sentencepiece_bpe.Codec(MODEL, 0.0), sentencepiece_bpe.Codec(MODEL, 0.3, 5)


def each(codec, texts):
    """Pieces of every text."""
    ids, many, good = codec.encode(pa.array(texts, pa.string()))
    assert good.all() and len(many) == len(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])]


@functools.cache
def scored(sp):
    """Ids and scores of all pieces that aren't bytes or signals."""
    return {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


def plain_agenda(sp, chunk, skips):
    """The agenda with skips, by looking at all neighbouring pairs before every take; written from its definition."""
    symbols, banned, t = list(chunk.replace(" ", "\u2581")), set(), 0
    tags = list(range(len(symbols)))  # a skipped candidate stays out as long as both its symbols stand
    names = scored(sp)
    known = [c == " " or c != "\u2581" and c in names for c in chunk]
    fresh = len(symbols)
    while True:
        found = [(-names[symbols[i] + symbols[i + 1]][1], i) for i in range(len(symbols) - 1) if known[i] and known[i + 1] and symbols[i] + symbols[i + 1] in names and (tags[i], tags[i + 1]) not in banned]
        if not found:
            break
        _, i = min(found)
        if t in skips:
            banned.add((tags[i], tags[i + 1]))
        else:
            symbols[i : i + 2], tags[i : i + 2], known[i : i + 2] = [symbols[i] + symbols[i + 1]], [fresh], [True]
            fresh += 1
        t += 1
    return [x for s, k in zip(symbols, known, strict=True) for x in ([names[s][0]] if k else [sp.piece_to_id(f"<0x{b:02X}>") for b in s.encode()])], t


def plain_skips(x, dropout, takes):
    """Geometric gaps from splitmix64 draws, in integers and floats of the language."""
    m, out, at, k = (1 << 64) - 1, set(), -1, 0
    while at < takes:
        z = (x + k * 0x9FB21C651E98DF25 + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        z ^= z >> 31
        at += 1 + (int(math.log(((z >> 11) + 0.5) / (1 << 53)) / math.log1p(-dropout)) if dropout < 1 else 0)
        out.add(at)
        k += 1
    return out


def plain_encode(sp, text, dropout, seed):
    m, out = (1 << 64) - 1, []
    whole = xxhash.xxh3_64_intdigest(text.encode(), seed)
    for place, chunk in enumerate(re.findall(" *[^ ]+| +", " " + text) if text else []):
        z = (place * 0xD1342543DE82EF95 + whole + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        out += plain_agenda(sp, chunk, plain_skips(z ^ (z >> 31), dropout, 3 * len(chunk)))[0]
    return out


def test_without_dropout_it_is_the_librarys_encoding(codecs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = [t for t in texts.values() if t]
    assert each(codecs[0], some) == sp.encode(some)


@pytest.mark.parametrize(("dropout", "seed"), [(0.1, 17), (0.5, 3), (1.0, 0)])
def test_dropout_equals_a_plain_agenda(texts, dropout, seed):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sentencepiece_bpe.Codec(MODEL, dropout, seed)
    some = [t[:1000] for t in texts.values() if t][:25] + ["", " ", "a  b ", "\u2581x  y", "日本語 " * 3, "z" * 130 + " ab", "word " + "internationalisation" * 9]
    for _ in range(2):  # with an empty forest, and with one
        assert each(codec, some) == [plain_encode(sp, t, dropout, seed) for t in some]


def test_dropout_varies_and_loses_nothing(codecs, texts):
    plain, dropped = codecs
    some = [t for t in texts.values() if t]
    got = each(dropped, some)
    assert all(dropped.decode(np.array(x)) == t for x, t in zip(got, some, strict=True))
    assert sum(x != y for x, y in zip(got, each(plain, some), strict=True)) > 0.9 * len(some)
    small = sentencepiece_bpe.Codec(MODEL, 0.3, 5, room=10)  # a forest that starts anew with every batch
    assert [x for t in some[::-1] for x in each(small, [t])][::-1] == got
    assert each(sentencepiece_bpe.Codec(MODEL, 0.3, 6), some) != got


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_survives(text):
    c = _codec()
    assert c.decode(np.array(c.pieces(text), np.int64)) == text


def _codec(made=[]):  # noqa: B006
    if not made:
        made.append(sentencepiece_bpe.Codec(MODEL, 0.4, 1))
    return made[0]


def test_skips_are_drawn_for_each_occurrence():
    """One word has as many segmentations as independent draws give it, within a text and over texts."""
    c = sentencepiece_bpe.Codec(MODEL, 0.1, 17)
    rng = np.random.default_rng(3)
    for word in ("information", "of", "unbelievably"):
        want = Counter(tuple(c.heaped(c.signs(" " + word), np.flatnonzero(rng.random(64) < 0.1).tolist())[0]) for _ in range(4000))
        within, got, at = c.pieces(" ".join([word] * 4000)), Counter(), 0
        for e in [*(i for i, p in enumerate(within) if c.spelled[p][:1] == b" " and i), len(within)]:
            got[tuple(within[at:e])] += 1
            at = e
        assert sum(got.values()) == 4000 and all(abs(got[k] - want[k]) < 120 for k in got | want)
        assert len(got) > 4 or word == "of"
    assert len({tuple(x[-6:]) for x in each(c, [f"w{i} information" for i in range(1000)])}) > 12


def test_texts_without_blanks():
    """Megabytes without a blank are one chunk: none of it is kept in the forest."""
    c = sentencepiece_bpe.Codec(MODEL, 0.1, 17)
    text = "".join(f"palavra{i % 977}ção" for i in range(200_000))
    assert len(text) > 2 << 20 and c.decode(np.array(c.pieces(text))) == text
    assert c.word.n == 0
    assert sentencepiece_bpe.Codec(MODEL, 0.0).pieces(text[:50_000]) == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text[:50_000])


def test_sentencepiece_query(spark, data, texts, odd, none):
    rows = queries.op1_sentencepiece(spark, data).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode(queries.op1_sentencepiece(spark, data), MODEL).collect()}
    assert back == {i: t or "" for i, t in texts.items()}
    got = sentencepiece_bpe.encode(odd, MODEL)
    assert got.count() == odd.count() and got.where("not lossless").count() == 0
    assert {r.n_pieces for r in got.where("doc_id in (1, 2)").collect()} == {0}
    assert sentencepiece_bpe.encode(none, MODEL).count() == 0


def test_shards(spark, data, texts, odd, none):
    tool = Tokenizer.from_file(path("byte_bpe_50k.json"))
    start, want = 0, []
    for i in sorted(texts):
        ids = [*tool.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op7_sstable(spark, data).collect()) == want
    rows = sstable.round_trip(odd, path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.doc_id for r in rows][:3] == [None, 1, 2] and len(rows) == odd.count()
    assert rows[1].n_tokens == rows[2].n_tokens == 1
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert sstable.round_trip(none, path("byte_bpe_50k.json")).count() == 0


def test_shards_on_disk(spark, data, texts, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sstable.write(docs, str(tmp_path / "t"), path("byte_bpe_50k.json"), shard_bytes=100_000)
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) > 1
    tables = [sstable.Reader(io.BytesIO(f.read_bytes()), f.stat().st_size) for f in files if f.stat().st_size]
    tool = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for i in list(texts)[::17]:
        hits = [x for x in (t.get(i) for t in tables) if x is not None]
        assert [h.tolist() for h in hits] == [[*tool.encode(texts[i] or "", add_special_tokens=False).ids, 0]]
    assert all(t.get(10**9 + k) is None for t in tables for k in range(50))
    assert [k for t in sorted(tables, key=lambda t: t.shard) for k, _ in t] == sorted(texts)


@pytest.mark.parametrize("text", ["", " a", "a ", "a  b", "a \nb", "a\n b", "don't  we've", "x<|endoftext|> y", "日本 語 é", "\0a b", "a  b　 c", "\n \n", "1 22  333", "a\n \nb", "a\u00a0 b \u3000c", "a \u2003 b", "été le soir", "x\u0085 y", "w" * 300 + " a " + "v" * 300, "a b\n", " \n a"])
def test_words_encode_as_the_library_does(text):
    tool = sstable.Encoder(path("byte_bpe_50k.json"))
    for _ in range(2):
        ids, many = tool.encode(pa.array(["b", text, None, text]))
        own = tool.tool.encode(text, add_special_tokens=False).ids
        assert np.split(ids, np.cumsum(many)[:-1])[1].tolist() == own == ids[len(ids) - len(own) :].tolist() and many.tolist() == [1, len(own), 0, len(own)]


_ENCODER = []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é'1.\n\t\u00a0\u2003\u3000<|日  "), max_size=30), max_size=6))
def test_any_texts_encode_as_the_library_does(some):
    if not _ENCODER:
        _ENCODER.append(sstable.Encoder(path("byte_bpe_50k.json"), room=20))
    ids, many = _ENCODER[0].encode(pa.array(some, pa.string()))
    want = [_ENCODER[0].tool.encode(t, add_special_tokens=False).ids for t in some]
    assert many.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(values):
    s = np.array(values, np.int64)
    assert suffixdedup.suffix_array(s).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def brute_digest(texts, length):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = Counter(hashlib.md5(b[i : i + length]).digest() for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[hashlib.md5(b[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        n = sum(gone)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(b), n, spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_query_equals_brute_force(spark, data, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_suffixdedup(spark, data).collect()}
    assert got == brute_digest(texts, 200)


@pytest.mark.parametrize("group", [1 << 20, 2000])
def test_suffix_edges(spark, monkeypatch, group):
    """Shared passages with many different surroundings, periodic texts, and a group counted window by window."""
    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    core, inner = word(330), word(199)
    texts = {i: word(int(rng.integers(0, 300))) + core + word(int(rng.integers(0, 300))) for i in range(40)}
    texts |= {100 + i: word(250) + inner + word(250) for i in range(5)}
    texts |= {200: "ab" * 300, 201: "ab" * 100, 202: "abc" * 200 + "é" * 150, 203: core[:205], 204: core[1:200], 205: None, 206: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    orig = suffixdedup.spans
    monkeypatch.setattr(suffixdedup, "spans", lambda d, length=200: orig(d, length, group))
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.digest(df).collect()}
    assert got == brute_digest(texts, 200)


def test_strip(odd, none):
    out = suffixdedup.strip(odd)
    assert out.columns == odd.columns and suffixdedup.strip(none).count() == 0
    rows = defaultdict(list)
    for r in out.collect():
        rows[r.doc_id].append(r)
    assert 4 not in rows and 5 not in rows and rows[8][0].text == "12 34 !!" and rows[1][0].text is None
    assert len(rows[9]) == 2 and rows[9][0].n_chars == len(rows[9][0].text)


PAGES = {
    None: "", "": "", "<p>": "", "just text": "just text",
    "<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One<br>two<p>three&nbsp;four</article><footer>c</footer>": "T & U\n\nOne two\n\nthree four",
    "<div class='cookie-notice'>We use</div><main><article><p>Hello <i>wor</i>ld</p><aside>rel</aside><section class='comments'><p>first!</p></section><form>f</form><script>x()</script></article></main>": "Hello world",
    "<article>open <b>bold<p>next &lt;tag&gt;": "open bold\n\nnext <tag>",
    "<ul><li><a href=a>menu one</a><li><a href=b>menu two</a></ul><div><h2>Head</h2><p>" + "long text " * 30 + "<p>short<p>" + "more words " * 30 + "</div>": "Head\n\n" + ("long text " * 30).strip() + "\n\nshort\n\n" + ("more words " * 30).strip(),
}


LONG = ("long text of the story " * 12).strip()
PAGES |= {
    f"<div class='layout has-sidebar'><article><p>{LONG}</article></div>": LONG, f"<div class='post no-sidebar'><p>{LONG}<p>{LONG}</div>": f"{LONG}\n\n{LONG}",
    "<article><p>One <svg><text>icon</text></svg><button>Buy</button>two<script>x()</script> three</article>": "One two three",
    "<article><p>Kept <span class='advert'>buy now</span><span hidden>secret</span><i class='sharp'>too</i></article>": "Kept too",
    f"<article><p>{LONG}<p><a href=x>one link alone</a><p>end</article>": f"{LONG}\n\none link alone\n\nend",
    f"<article><p>{LONG}</article><article><p>{LONG} 2</article><aside><article><p>{LONG} 3</article></aside>": f"{LONG}\n\n{LONG} 2",
    f"<main><h1>Head</h1><p>{LONG}<article><p>{LONG}</article><div><a href=a>a</a></div></main>": f"Head\n\n{LONG}\n\n{LONG}",
    f"<div class='main-sidebar-layout'><h1>Head</h1><p>{LONG}</div><div class='sidebar'>side text</div>": f"Head\n\n{LONG}",
    f"<article><h1>Head</h1><p>{LONG}</article><section class='comments'>{'<p>a reader says this and that and more' * 40}</section>": f"Head\n\n{LONG}",
    f"<form id=all><nav><a href=x>x</a></nav><main><p>{LONG}</main></form><form><input><p>Your name</form>": LONG,
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert htmltext.main_text(html) == PAGES[html]


def built_page(rng, tag):
    """A page and its article, made of known blocks."""
    word = lambda n: " ".join("".join(rng.choice(list("abcdeiou"), int(rng.integers(2, 9)))) for _ in range(n))
    links = lambda n: "".join(f"<li><a href=/x>{word(1)}</a>" for _ in range(n))
    blocks = [word(5)] + [word(int(rng.integers(8, 90))) for _ in range(int(rng.integers(3, 9)))]
    blocks.insert(int(rng.integers(2, len(blocks))), word(1))  # a short paragraph
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    html = f"<body><ul>{links(9)}</ul><div><p>{word(6)}</p></div><{tag}>{body}</{tag}><div><ul>{links(7)}</ul><p>{word(4)}</p></div></body>"
    return html, "\n\n".join(blocks)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_regions_without_any_name(tag):
    """Menus, an advert and a footer without names: the ratio alone finds the article, marked or not."""
    rng = np.random.default_rng(11)
    pages = [built_page(rng, tag) for _ in range(200)]
    assert sum(htmltext.main_text(h) == t for h, t in pages) >= 0.9 * len(pages)


def test_smoothing_decides():
    """Paragraphs in the body itself: a short one between long ones is content, short ones at the end are not."""
    html = "<body>" + f"<p>{LONG}" * 3 + "<p>Yes." + f"<p>{LONG}" * 3 + "<p>a b<p>c d<p>e f<p>g h<p>i j" + "</body>"
    page = htmltext.Page()
    page.feed(html)
    page.cut()
    assert htmltext._pick(page) == [LONG] * 3 + ["Yes."] + [LONG] * 3 + htmltext._pick(page)[7:] and len(htmltext._pick(page)) <= 8
    assert "Yes." not in htmltext._pick(page, sigma=0.01)


def test_html_query(spark, data):
    """Every page's text is that of its article, and stays so where the article is an element without a meaning."""
    import duckdb

    pages = dict(duckdb.sql(f"select page_id, html from '{data}/pages.parquet'").fetchall())
    rows = queries.op2_htmltext(spark, data).collect()
    assert {r.page_id for r in rows} == set(pages)
    same = 0
    for r in rows:
        inner = (pages[r.page_id] or "").partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|section|blockquote|pre|table|tr|td)\b[^>]*>", inner)
        plain = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", b) if "<" in b else b).split()) if "<" not in b.replace("<br>", "") else " ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in plain if b) and r.n_chars == len(r.text)
        same += htmltext.main_text(re.sub(r"<(/?)article\b", r"<\1div", pages[r.page_id] or "")) == r.text
    assert same >= 0.9 * len(rows)
    odd = spark.createDataFrame([(1, None, "<p>x"), (1, None, "<p>x"), (None, "u", None), (2, "u", "<article><p>" + "w " * (1 << 20) + "</article>")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.n_chars) for r in htmltext.extract(odd).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, (2 << 20) - 1)]
    assert htmltext.extract(odd.where("false")).count() == 0


def test_smoothing_and_clusters():
    assert htmltext.smooth([4.0, 4.0, 4.0]) == pytest.approx([4, 4, 4])
    assert 1 < htmltext.threshold([1, 1, 1, 9, 9]) < 9 and htmltext.threshold([]) == 0
