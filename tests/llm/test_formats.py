import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import empty, odd_rows, prose, rng, table
from voxlake.llm import chat, packing, scratch, warc

# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.Vocabulary.public().json_path)


def test_pieces_are_the_tokenizers_ids(spark, tokenizer):
    r = rng(8)
    rows = odd_rows(r) + [(100 + i, prose(r, r.randint(0, 4000))) for i in range(60)] + [(90, "a <|endoftext|> b"), (91, " " * 50_000 + "x"), (92, "\r\n\t I'll've  don't 漢字🙂\u00a0x")]
    out = packing.pack(table(spark, rows), packing.Vocabulary.public()).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            p = ids[a : a + 2048]
            want[i, a, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes()), len(ids)] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in out) == want
    held = defaultdict(list)
    for x in out:
        held[x.sequence_id].append((x.offset, x.length, x.padding))
    assert sorted(held) == list(range(len(held)))
    for parts in held.values():
        at = 0
        for offset, length, padding in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and all(p == (0 if at & (at - 1) == 0 else 2048 - at) for *_, p in parts)
    assert packing.pack(empty(spark), packing.Vocabulary.public()).isEmpty()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=20) | st.sampled_from(["'s", "'LL", "  ", "\n\n", "\u00a0", "\u2028", "\r\n", "12345", "<|endoftext|>", "\u200d", "e\u0301", "\u1e9e"]), max_size=8).map("".join))
def test_both_encoders_agree_on_any_text(tokenizer, text):
    assert packing.encoder(packing.Vocabulary.public())(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_place_every_length(histogram):
    packs = packing.patterns(histogram, 64)
    placed = Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 64
        for x in lengths:
            placed[x] += count
    assert placed == Counter(histogram)
    used, total = sum(c for c, _ in packs), sum(k * v for k, v in histogram.items())
    assert used <= 2 * -(-total // 64) + 1


# --- chat

CONTROL = r"\### Assistant: </turn> ok"
text = st.text(st.sampled_from(list("\\#</turn> AUs:\né")) | st.characters(codec="utf-8"), max_size=30) | st.sampled_from([CONTROL, "### User: x</turn>\n", "\\", "\\\\", "#", "####", "</turn>", "<", "</turn>\n### Assistant: "])


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool: x", "=a%", "### "]), text), max_size=6))
def test_turns_are_read_back(turns):
    t = chat.Template()
    reader, got = chat.Reader(t), []
    for role, said in turns:
        for part, loss in t.segments(role, said):
            got += reader.feed(part, loss)
    assert [(r, s) for r, s, _ in got] == turns and not reader.text
    assert [x for *_, x in got] == [s if r == "assistant" else "" for r, s in turns]
    whole = "".join(part for role, said in turns for part, _ in t.segments(role, said))
    assert [(r, s) for r, s, _ in chat.Reader(t).feed(whole, False)] == turns


def test_digests_of_odd_conversations(spark):
    long = [(9, i, ["user", "assistant"][i % 2], "x" * i) for i in range(3000)]
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "?"), (None, 0, "user", "a"), (3, None, "user", "late"), (3, 0, "assistant", "no"), (4, 0, "user", "same"), (4, 0, "user", "same"), (-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL), *long]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as state", "1 as loss")
    t = chat.Template()
    got = {r.conv_id: r for r in chat.digests(chat.segments(df, t), t).collect()}
    assert len(got) == 7
    by = defaultdict(list)
    for c, turn, role, said in rows:
        by[c].append((turn if turn is not None else -1, role or "", said or ""))
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(s for _, r, s in turns if r == "assistant")
        x = got[c]
        assert (x.n_turns, x.loss_chars) == (len(turns), len(learnt))
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{s}\n" for _, r, s in turns).encode()).hexdigest()
        assert x.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert x.formatted_chars == sum(len(p) for _, r, s in turns for p, _ in t.segments(r, s))
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, None: True, 3: True, 4: False, -7: True, 9: True}
    assert chat.digests(chat.segments(df.limit(0), t), t).isEmpty()


def test_another_template():
    t = chat.Template(labels={"user": "U", "assistant": "A"}, mark="<<", after_mark="", after_label=">>", close="[/]", between="", escape="~")
    out = [x for r, s in [("user", "a<<U>>[/]~"), ("assistant", "~<<")] for p, loss in t.segments(r, s) for x in [(p, loss)]]
    reader = chat.Reader(t)
    assert [y for p, loss in out for y in reader.feed(p, loss)] == [("user", "a<<U>>[/]~", ""), ("assistant", "~<<", "~<<")]


# --- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, size string").repartition(3)


def test_archives_are_read_back(spark):
    big, other = "<p>é</p>" * 200, "<b>" * 400
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a/\r\n3", big), (None, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (9, "u", "x" * 300_000)]
    path = scratch.new_dir(spark, "warc-test")
    manifest = warc.write(pages(spark, rows), path)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read(manifest, path).collect())
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 5
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None, None if revisit else data] += 1
    assert got == want
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    assert warc.round_trip(pages(spark, rows).limit(0)).isEmpty()


def test_frames_of_an_archive():
    import struct

    import zstandard

    out = io.BytesIO()
    out.close_ = out.close
    out.close = lambda: None
    w = warc.Writer(out)
    recs = [warc.record(i, f"http://x/{i}", prose(rng(i), 300).encode(), "00" * 20, 1, None, False, "2024-01-01T00:00:00Z", "") for i in range(3000)]
    for r in recs:
        w.add(r)
    w.close()
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICT_MAGIC
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj()
    assert first.decompress(data[8 + size :]) == recs[0]  # a frame holds one record
    assert [f["X-Page-ID"] for f, _ in warc.read_records(io.BytesIO(data))] == [str(i) for i in range(3000)]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in recs)
    assert len(data) < plain  # what the dictionary is for


def test_archives_are_read_by_as_many_tasks(spark, tmp_path):
    """Paths are few bytes, so Spark would merge their partitions into one task if they had no number of their own."""
    pages = spark.createDataFrame([(i, "u", prose(rng(i), 300)) for i in range(40)], "page_id long, url string, html string").repartition(8)
    manifest = warc.write(pages, f"file://{tmp_path}", archive_bytes=4000)
    read = warc.read(manifest, f"file://{tmp_path}")
    assert manifest.count() > 8 and read.rdd.getNumPartitions() == manifest.count()
    assert "REPARTITION_BY_NUM" in read._jdf.queryExecution().executedPlan().toString() and read.count() == 40


def test_the_shared_folder(spark, monkeypatch):
    """What a stage has made can be removed from a mark on; the session's setting stays as it was."""
    mark = scratch.mark()
    table_ = scratch.stored(spark.range(10), "x")
    assert scratch.mark() == mark + 1 and spark.conf.get(scratch._CLEANUP, None) in (None, "false")
    scratch.clear(spark, mark)
    with pytest.raises(Exception, match="(?i)exist"):
        table_.collect()


class _Kept(io.BytesIO):
    """A file whose bytes stay after it is closed, and that knows where each record begins."""

    def close(self):
        self.data = self.getvalue()


def test_cut_archives_are_errors():
    """Cut at every byte of the last two records: between them the archive is whole but short, anywhere else it is an error."""
    ends, out = [], _Kept()
    w = warc.Writer(out)
    for i in range(30):
        payload = prose(rng(i), 40).encode()
        w.add(warc.record(i, "u", payload, hashlib.sha1(payload).hexdigest(), len(payload), None, False, "2024-01-01T00:00:00Z", f"a:{i}"))
    w.close()
    at = 0
    for k in range(len(out.data)):
        if out.data[k : k + 4] == b"\x28\xb5\x2f\xfd" and k > 8 + int.from_bytes(out.data[4:8], "little") - 1:
            ends.append(k)
    assert len(ends) == 30
    for at in range(ends[-2] + 1, len(out.data)):
        if at == ends[-1]:
            assert len(list(warc.read_records(io.BytesIO(out.data[:at])))) == 29
            continue
        with pytest.raises(ValueError, match="ends inside a record"):
            list(warc.read_records(io.BytesIO(out.data[:at])))
    for at in (0, 5, 8, 20):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(out.data[:at])))


def test_an_archive_with_fewer_records_than_counted_is_an_error(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, "u", prose(rng(i), 30)) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(pages, f"file://{tmp_path}")
    with pytest.raises(Exception, match="5 records of 6"):
        warc.read(manifest.withColumn("n_records", F.col("n_records") + 1), f"file://{tmp_path}").collect()
