import base64
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from labeldates.llm import extract, warc
from labeldates.llm.common import fresh_path


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<article><p>one</p></article>", "", None, "<article><p>one</p></article>", "x" * 200_000, "é😀"]
    rows = [(i, f"http://e.org/{i}\r\nX: y", html[i % 6]) for i in range(60)] + [(None, None, "<article><p>one</p></article>"), (54, "again", "<article><p>one</p></article>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("refers_to", F.lit("clash"))


def test_archives_round_trip(spark, pages):
    for least, size in ((0, 64 << 20), (1, 3000)):
        manifest = warc.write(pages.repartition(3), fresh_path(spark, "warc-test"), least=least, package_bytes=size)
        got = sorted(warc.read(manifest).drop("url").collect(), key=str)
        raw = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
        top = {}
        for i, b in raw:
            top[b] = max(top.get(b, -1), -1 if i is None else i)
        want = []
        for i, b in raw:
            revisit = len(b) >= least and (i is None or i < top[b])
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[b] if revisit else None))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.read(warc.write(pages.limit(0), fresh_path(spark, "warc-test"))).count() == 0


def test_packages_are_ordinary_zip_files():
    rng = random.Random(1)
    for wide in (False, True):
        out = io.BytesIO()
        z = warc.ZipWriter(out, wide=wide)
        members = {f"a/{i}": rng.randbytes(rng.randint(0, 2000)) for i in range(20)}
        for name, data in members.items():
            z.add(name, data)
        z.finish()
        data = out.getvalue()
        with zipfile.ZipFile(io.BytesIO(data)) as other:
            assert other.testzip() is None and {n: other.read(n) for n in other.namelist()} == members
        reads = []

        def read(at, n, data=data, reads=reads):
            reads.append(n)
            return data[at : at + n]

        mine = warc.ZipReader(read, len(data))
        for name, want in members.items():
            at, n = mine.stored(name)
            assert data[at : at + n] == want
    # and the other way round, with a comment that looks like an end record
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as other:
        other.writestr("x", b"stored")
        other.writestr("y", b"packed" * 50, zipfile.ZIP_DEFLATED)
        other.comment = b"PK\x05\x06 not the end"
    data = out.getvalue()
    mine = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, n = mine.stored("x")
    assert data[at : at + n] == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        mine.stored("y")
    with pytest.raises(ValueError):
        warc.ZipReader(lambda at, n: b"nothing"[at : at + n], 7)


def test_damage_is_noticed():
    whole = warc.record(1, "u", b"payload", warc.digest(b"payload"))
    assert warc.parse(whole)[1].endswith(b"payload")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(whole.replace(b"payload", b"pAyload"))


def test_base32_matches():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


@pytest.fixture(scope="module")
def model():
    return extract.train()


def texts(model, *pages):
    return extract.main_texts(model, list(pages), extract.Features(), {})


def test_held_out_pages(model):
    held = extract.labelled(150, seed=99)
    got = texts(model, *[p for p, _ in held])
    assert sum(g == "\n\n".join(" ".join(t.split()) for t in truth) for g, (_, truth) in zip(got, held, strict=True)) >= 147


def test_page_of_every_part(model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>a{}</style><script>if (a<b) "</p>"</script></head><body><header class="masthead"><a href=/>Site</a></header><nav><ul><li><a href="/a">Menu</a><li><a>Other</a></ul></nav>
    <div class=ad>Buy now</div><article><h1>Title &amp; more&#33;</h1><p><b>First\n  &lt;para&gt;<br>on<!-- no --> one <i>line</i>.<p>Be.</p><ul><li>Item one<li>Item <a href=x>two</a></ul>
    <form><label>Mail</label><input></form><aside><p>Read also this other story of ours.</p></aside><blockquote><p>Quoted words.</p></blockquote></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thanks.</p></div></section><div class="cookie-notice">We use cookies.</div><footer>&copy; us</footer>"""
    assert texts(model, page)[0] == "Title & more!\n\nFirst <para> on one line.\n\nBe.\n\nItem one\n\nItem two\n\nQuoted words."


def test_odd_pages(spark, model, pages):
    empty = ["", "<article", "<article><p", "</p></div>", "<!-- never closed", "<script>never closed", "<p>" * 20_000]
    assert texts(model, *empty) == [""] * 7
    assert len(texts(model, "<", "<div>" * 5000 + "x", "a < b <c", '<a href="unclosed>x</a>', "&#0;&bogus;&amp")) == 5
    assert texts(model, "<body><p>Only a paragraph of text.</p>") == ["Only a paragraph of text."]  # no article is marked
    rows = {r["page_id"]: r for r in extract.main_text(pages, model).collect()}
    assert rows[0]["text"] == "one" and rows[0]["n_chars"] == 3 and rows[1]["text"] == rows[2]["text"] == "" and rows[None]["text"] == "one"
    assert extract.main_text(pages.limit(0), model).count() == 0 and extract.main_text(pages, model).columns == ["page_id", "url", "text", "n_chars"]


def test_blocks_follow_the_markup():
    found = extract.blocks("<div>a<p>b<p>c<b>d</b>e</div>f<br>g<table><tr><td>h<td>i</table>")
    assert [b.text for b in found] == ["a", "b", "cde", "f g", "h", "i"]


def test_empty_silent_elements_and_open_head():
    of = lambda page: [b.text for b in extract.blocks(page)]
    assert of("<article><p>A <svg viewBox='0 0 1 1'/> B <math/></p><p>C</p></article>") == ["A B", "C"]
    assert of("<svg><text>no</text></svg><p>D</p>") == ["D"]
    assert of("<html><head><title>t</title><meta charset=x><script>s</script><p>E</p><p>F</p>") == ["E", "F"]
    assert of("<head><noscript><img src=x></noscript><title>t</title></head><body><p>G</p>") == ["G"]
