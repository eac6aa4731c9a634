"""Each operator on a small table with all the odd cases, against a plain version."""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import components, exact_dedup, language_id, minhash, packing, pii, pii_labels, quality, run_index, sentencepieces, shared, token_planes, tokens, warc

WORDS = "the and of house river stone light over under green field walk talk night day".split()
GERMAN = "der und die haus fluss stein licht über unter grün feld gehen nacht tag ist".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(words[k] for k in rng.integers(0, len(words), n))


LONG = prose(1, 30_000)
NEAR = prose(2, 300).split()
TEXTS = [
    None, "", " \n\t ", "a", "a a", "one two three", "one two three", "One  two\tthree", LONG, LONG, LONG + " x",
    " ".join(NEAR), " ".join(NEAR[:150] + ["changed"] + NEAR[151:]), " ".join(NEAR[:20] + ["other"] + NEAR[21:]), prose(3, 120), prose(4, 120) + "\n" + " ".join(NEAR[10:60]),
    prose(5, 200, GERMAN), prose(6, 200, GERMAN), "x" * 5000, "€uro ünïcode <|endoftext|> don't 12,5% ﬁn", "line a b c\n" * 30, "😀 emoji ퟿ ok", "y" * 99, "y" * 100, "y" * 101,
    "mail a.b@c.de, +1 (234) 555-6789 1.2.3.4 5.6.7.8 and 4111 1111 1111 1111 end", "999.1.1.1 a@b a@b.c@d.e +12 x", "+1 (826) 555-4081 190.137.223.204 4111111111111111",
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The texts, one row twice, a null id, and further columns whose names the operators use themselves."""
    rows = [(k, t, "de" if k in (16, 17) else "en" if k % 5 else None, f"s{k % 2}" if k % 7 else None) for k, t in enumerate(TEXTS)]
    rows += [rows[14], (None, "no id at all here", None, None)]
    path = str(tmp_path_factory.mktemp("docs"))
    extra = "_row long, key string, name string, n long, node long, kept string, bucket int, text_sha256 string, best string"
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", "n", 2, 3, "x", 4, "y", "z") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    df.limit(0).write.parquet(f"{path}/empty.parquet")
    return path


@pytest.fixture
def table(spark, docs):
    shared.session_setup(spark)
    return spark.read.parquet(f"{docs}/documents.parquet")


@pytest.fixture
def empty(spark, docs):
    shared.session_setup(spark)
    return spark.read.parquet(f"{docs}/empty.parquet")


def folder(spark) -> str:
    return shared.work_dir(spark, "test")


def plain_ids(text) -> bytes:
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 2], "<u4").tobytes()


def ordered_rows(table):
    return sorted(((r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


# ---- 1
@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(0)
    docs = [(None, np.empty(0, "<u4"))] + [(k, rng.integers(0, 2**32 if k % 3 == 0 else 50_000, n, dtype=np.uint32)) for k, n in enumerate([0, 1, 7, 64, 1000, 129, 0])]
    out = io.BytesIO()
    writer = token_planes.Writer(out, block_ids=64, bits=bits)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    reader = token_planes.Reader(out)
    assert [(d, x.tolist()) for d, _, x in reader] == [(d, x.tolist()) for d, x in docs]
    assert [reader.ids(k).tolist() for k in range(len(docs))] == [x.tolist() for _, x in docs]


def test_token_planes(spark, table, empty):
    at, want = 0, []
    for doc_id, text in ordered_rows(table):
        ids = plain_ids(text)
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    for df, rows in ((table, want), (empty, [])):
        place = folder(spark)
        got = token_planes.read_tokens(spark, place, token_planes.write_tokens(df, place, tokens.default_path(), block_ids=256))
        assert sorted(tuple(r)[:4] for r in got.where("doc_id is not null").collect()) == sorted(r for r in rows if r[0] is not None)
        assert got.count() == len(rows)


# ---- 2
def test_warc(spark, tmp_path):
    big = "<p>" + "z" * 200
    rows = [(5, "http://a b", big), (2, None, big), (2, "http://c", big), (3, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "u", "ü\r\n\r\n" * 40)]
    schema = "page_id long, url string, html string"
    for some in (rows, []):
        path = f"{tmp_path}/{len(some)}"
        spark.createDataFrame(some, schema).repartition(2).write.parquet(path)
        place = folder(spark)
        got = warc.read_archives(spark, place, warc.write_archives(warc.typed(spark.read.parquet(path)), place)).collect()
        body = lambda r: (r[2] or "").encode()
        assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((r[0] or -1, len(body(r)), hashlib.sha256(body(r)).hexdigest()) for r in some)
        kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got)
        if some:
            assert kinds == [(-1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (3, "response", None), (4, "response", None), (5, "revisit", 2), (6, "response", None), (7, "response", None), (8, "response", None)]


def test_warc_with_clashing_columns_and_no_scan(spark, tmp_path):
    rows = [(k, "u", "<p>" + "z" * 200, 1, "x", "k", 5) for k in (4, 3, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _row long, digest string, key string, payload int")
    df.repartition(2).write.parquet(f"{tmp_path}/p")
    got = warc.typed(spark.read.parquet(f"{tmp_path}/p")).collect()
    assert sorted((r["page_id"], r["revisit"], r["refers_to"]) for r in got) == [(3, False, None), (3, True, 3), (4, True, 3)]
    with pytest.raises(ValueError, match="scan"):
        warc.typed(df)
    with pytest.raises(ValueError, match="header"):
        list(warc.Records(io.BytesIO(zlib.compress(b"WARC/1.1\r\nWARC-Type: response\r\n", wbits=31))))


def test_warc_reader_keeps_payloads_and_finds_damage():
    payload = "häuser\r\n\r\n".encode() * 30_000
    digest = hashlib.sha256(payload).hexdigest()
    archive = warc.record(1, "u", payload, digest, None, False) + warc.record(2, "u", payload, digest, 1, True)
    one, two = list(warc.Records(io.BytesIO(archive), keep=True))
    assert one["payload"] == payload and two["fields"]["WARC-Refers-To"] == "<urn:page:1>" and two["payload_bytes"] == len(payload)
    for bad in (warc.record(1, "u", payload, "0" * 64, None, False), archive[:500]):
        with pytest.raises(ValueError):
            list(warc.Records(io.BytesIO(bad)))


# ---- 3
@pytest.mark.parametrize("n_open", [1, 3])
def test_packing(spark, table, empty, n_open):
    assert packing.pack(empty, tokens.default_path(), folder(spark)).count() == 0
    got = packing.pack(table, tokens.default_path(), folder(spark), window=64, n_open=n_open).collect()
    texts = {(d, t) for d, t in ordered_rows(table)}
    ids = {d: plain_ids(t) for d, t in texts}
    twice = {14}
    for d, whole in ids.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d)
        times = 2 if d in twice else 1
        assert sum(n for _, n, _ in mine) == times * len(whole) // 4
        assert all(zlib.crc32(whole[4 * a : 4 * (a + n)]) == c for a, n, c in mine)
        if times == 1:
            at = 0
            for a, n, _ in mine:
                assert a == at
                at += n
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0  # full, or a power of two


# ---- 4
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, g in itertools.groupby(sorted(windows)) if len(list(g)) > 1}
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, table, empty):
    assert quality.judged(empty, folder(spark)).count() == 0
    got = quality.judged(table, folder(spark)).collect()
    want = sorted((-1 if d is None else d, *plain_counts(t)) for d, t in ordered_rows(table))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_thresholds_follow_the_group(spark, tmp_path):
    rows = [(k, prose(k, 100) + (" # *" * 40 if k % 10 == 0 else ""), "en", "a") for k in range(200)] + [(1000 + k, prose(k, 100).replace(" ", "$ "), "en", "signs") for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/d")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.read.parquet(f"{tmp_path}/d"), folder(spark)).collect()}
    assert all(got[k] == (k % 10 != 0) for k in range(200)) and all(got[1000 + k] for k in range(100))


def plain_fences(rows):
    """Of (lang, source, values): quantiles of each group's values, of its language's and of all's, by weight."""
    place = lambda x: quality.GROWTH ** np.ceil(np.log(x) / np.log(quality.GROWTH))
    out = {}
    for lang, source in {r[:2] for r in rows}:
        for m, (lo, hi, reach, _) in quality.MEASURES.items():
            each = [[place(r[2][m]) for r in rows if r[: len(key)] == key] for key in ((lang, source), (lang,), ())]
            weights = [np.full(len(each[2]), quality.PRIOR / len(each[2]))]
            weights.insert(0, np.ones(len(each[1])))
            total = len(each[1]) + quality.PRIOR
            weights = [np.ones(len(each[0])), *(w * quality.PRIOR / total for w in weights)]
            values, w = np.concatenate(each), np.concatenate(weights)
            order = np.argsort(values)
            at = np.cumsum(w[order]) / w.sum()
            a, b = (values[order][np.searchsorted(at, p / 100)] for p in (lo, hi))
            out[lang, source, m] = (b + reach * (b - a), a - reach * (b - a))
    return out


def test_each_measure_moves_its_fence(spark):
    """Groups that differ in one measure alone get other fences for it; small and large groups by one formula."""
    rng, rows = np.random.default_rng(0), []
    for source, moved, n in [("plain", None, 300), ("small", None, 3), *((m, m, k) for m, k in zip(quality.MEASURES, (200, 49, 50, 51), strict=True)), (None, "letters_a_word", 120)]:
        for _ in range(n):
            values = {"signs_a_word": 0.01, "repeated_lines": 0.1, "repeated_words": 0.02, "letters_a_word": 5.0}
            rows.append(("en" if source else None, source, {m: x * (3 if m == moved else 1) * rng.uniform(0.8, 1.25) for m, x in values.items()}))
    schema = "lang string, source string, " + ", ".join(f"{m} double" for m in quality.MEASURES)
    got = quality.group_fences(spark.createDataFrame([(a, b, *v.values()) for a, b, v in rows], schema), folder(spark)).collect()
    want = plain_fences(rows)
    assert len(got) == 7
    for r in got:
        for m, (_, _, _, both) in quality.MEASURES.items():
            high, low = want[r["lang"], r["source"], m]
            assert r["fence"][f"high_{m}"] == pytest.approx(high, rel=0.15) and (not both or r["fence"][f"low_{m}"] == pytest.approx(low, rel=0.15, abs=0.3))
    by = {r["source"]: r["fence"] for r in got}
    assert all(by[m][f"high_{m}"] > 1.5 * by["plain"][f"high_{m}"] for m in quality.MEASURES)


# ---- 5
def plain_repeats(rows, match):
    seen, out = set(), []
    for doc_id, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - match + 1):
            s = raw[k : k + match]
            if s in seen:
                gone[k : k + match] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((-1 if doc_id is None else doc_id, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_long_repeats(spark, table, empty):
    assert run_index.without_repeats(empty, folder(spark)).count() == 0
    got = run_index.without_repeats(table, folder(spark), run_index.Sizes(piece=4096, portion=1 << 14, stretch=512)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in got) == plain_repeats(ordered_rows(table), 100)


def test_run_index_against_plain_search():
    rng = np.random.default_rng(3)
    for turn in range(120):
        letters = b"ab" if turn % 2 else b"abc"
        some = lambda n: bytes(letters[k] for k in rng.integers(0, len(letters), n))
        strings = [some(rng.integers(0, 13)) for _ in range(rng.integers(1, 6))]
        depth = int(rng.integers(1, 5))
        index = run_index.RunIndex(strings, depth)
        want, seen = set(), set()
        for i, s in enumerate(strings):
            for p in range(len(s) - depth + 1):
                if s[p : p + depth] in seen:
                    want.add((i, p))
                seen.add(s[p : p + depth])
        body = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(x) for x in strings], np.int64)
        got = zip(*(x.tolist() for x in index.earlier(body, np.cumsum(sizes) - sizes, sizes)), strict=True)
        assert {(i, p) for i, p, early in got if early < index.begin[i] + p} == want
        pattern = some(8) + b"z" + some(4)
        stats = {int(at[0]): int(n[0]) for _, at, n, _ in index.statistics(np.frombuffer(pattern, np.uint8), np.array([0]), np.array([len(pattern)]))}
        for k in range(len(pattern)):
            assert stats[k] == min(depth, max(m for m in range(len(pattern) - k + 1) if m == 0 or any(pattern[k : k + m] in s for s in strings)))


def test_nothing_goes_without_the_index(spark, table, monkeypatch):
    """Hashes only say where to look: what goes are the index's matches, and nothing else."""
    monkeypatch.setattr(run_index, "marks", lambda answered, *_: answered.select("shard", answered["codes"].alias("spans")).limit(0))
    assert run_index.without_repeats(table, folder(spark)).where("n_removed > 0").count() == 0
    texts = [t.encode() for _, t in ordered_rows(table)]
    found = run_index.Anchors(texts)
    codes = np.full(len(found.first), run_index.AGAIN | run_index.ASKED, np.uint8)
    rows = [shared._batch([r], run_index.SENT) for r in sorted(run_index.parcels(found, texts, codes, np.full((len(codes), 2), -1, "<i4"), 0, 3), key=lambda r: r[:3])]
    seen = []
    monkeypatch.setattr(run_index.RunIndex, "earlier", lambda self, body, starts, sizes, begin=None: seen.append(len(starts)) or (np.empty(0, np.int64),) * 3)
    for kind, group in run_index._runs(rows):
        assert list(run_index.marked_copies(group, run_index.SIZES) if kind == run_index.COPIES else run_index.marked_bands(group, run_index.SIZES)) == []
    assert sum(seen) > 100


@pytest.mark.parametrize("hot", [2, 4096])
def test_a_line_amid_different_words(spark, tmp_path, hot):
    """Some hundred texts share a line, two lines, or half of one; portions, indexes and stretches are small."""
    sizes = run_index.Sizes(hot=hot, portion=4096, index_bytes=2048, stretch=64, stream_bytes=4096)
    line, rows = prose(77, 40), []
    for k in range(160):
        middle = line if k % 3 else line[: 60 + k] if k % 2 else line + " and " + line
        rows.append((k, f"{prose(1000 + k, 8)} {middle} {prose(2000 + k % 7, 12)}"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/d")
    got = run_index.without_repeats(spark.read.parquet(f"{tmp_path}/d"), folder(spark), sizes).collect()
    assert sorted(tuple(r) for r in got) == plain_repeats(rows, 100)


# ---- 6
def one_digit(block):
    return F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(block, 256), 1, 1)))


@pytest.mark.parametrize(("block_bytes", "digest"), [(16, exact_dedup.sha256), (16, one_digit), (1 << 10, exact_dedup.sha256), (1 << 14, one_digit)])
def test_exact_dedup(spark, table, empty, block_bytes, digest, monkeypatch):
    """Blocks of some sizes; digests of which each is shared by many blocks."""
    monkeypatch.setattr(exact_dedup.identities, "__defaults__", (block_bytes, digest))
    assert exact_dedup.groups(empty, folder(spark)).count() == 0
    if block_bytes == 16:
        table = table.where("length(coalesce(text, '')) < 6000")
    rows = ordered_rows(table)
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    got = exact_dedup.groups(table, folder(spark)).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(body(t), []).append((-len(t), d is None, d or 0, d))
    want = sorted((-1 if d is None else d, -1 if (k := min(groups[body(t)])[3]) is None else k, len(groups[body(t)]), hashlib.sha256(body(t).encode()).hexdigest()) for d, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


# ---- 7
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", pii.is_ip),
    "card": (r"[0-9]([\x20-]?[0-9])+", pii.is_card),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", pii.is_phone),
}


def test_patterns_against_plain_ones():
    rng = np.random.default_rng(5)
    texts = [t for t in TEXTS if t] + ["".join("ab1290.@+- ()"[k] for k in rng.integers(0, 13, 60)) for _ in range(3000)]
    for text in texts:
        got = pii.base_spans(text)
        for kind, (pattern, good) in PLAIN.items():
            assert got[kind] == [m.span() for m in re.finditer(pattern, text) if good(m.group())], (kind, text)


def test_personal_data(spark, table, empty):
    assert pii.found(empty).count() == 0 and pii.redacted(empty).count() == 0
    got = {r["doc_id"]: r for r in pii.found(table).collect()}
    at = next(k for k, t in enumerate(TEXTS) if t and t.startswith("+1 (826)"))
    assert (got[at]["n_phone"], got[at]["n_card"]) == (0, 0)
    assert {"phone:0:17", "ip:18:33"} <= set(got[at]["spans"].split(","))  # the pattern lost the phone, the field finds it
    clean = {r["doc_id"]: r for r in pii.redacted(table).collect()}
    assert clean[at]["text"].startswith("<PHONE> <IP>") and clean[at]["n_chars"] == len(clean[at]["text"]) and clean[0]["text"] is None
    assert clean[14]["text"] == TEXTS[14] and clean[14]["_row"] == 1


#: Other sentences than those of the labelled table, with other values.
UNSEEN = """
You may phone our desk on {phone:0161 496 0123} any weekday.
If lost, text {phone:(503) 555-0171} or mail {email:lost.found@museum.example.org}.
Meine Nummer ist {phone:0351/876 5432}, abends.
Voici mon numéro : {phone:04 93 12 34 56}
{email:anna.b @ example.com} wrote this on 3 May 2011
the gateway {ip:192.0.2.129} dropped 15 packets
blocked: {ip:198. 51. 100. 99} after 5 tries
she used card {card:4000056655665556} twice
charge {card:4000.0566.5566.5556} no more
Sein Handy ist {phone:0176 5550 1234}
new mobile {phone:070-1234 5678}, old one gone
the mail of {email:k.o @ fight-club.example.com} bounced
5 tickets for 12 euros, row 7, seats 14 to 18
he typed {card:5200828282828210} {card:5200828282828210} in a row
{phone:+1 (617) 555-0143} {ip:203.0.113.61} in one line
{phone:+1 (617) 555-0143} {card:4000056655665556} in one line
Our fax, {phone:+39 06 6982 1234}, is old.
sent by {email:r2_d2@droids.example.net}!
Release 10.2.4 of 14.02.2022 fixes 37 bugs
Between 12:30 and 14:45 some 1,200 people came
1 200 000 euros sur 10 ans
Figure 3.2.1 shows 25 to 30 of them
commit 9fceb02d0ae598e95dc970b74767f19372d61af8 on main
the years 1914-1918 and 1939-1945
buy 3 @ 4.99 or 10 @ 14.00
item 77-12 of lot 2019-04
"""


def test_the_field_on_sentences_it_has_not_seen():
    """Spans of the field and the patterns together, and how many of them the patterns alone find."""
    model, right, found, wanted, alone = pii.field(), 0, 0, 0, 0
    for text, spans in map(pii_labels.parsed, UNSEEN.strip().split("\n")):
        base, got = pii.all_spans([text], model)[0]
        got = {(k, a, b) for k in pii.KINDS for a, b in got[k]}
        right += len(got & set(spans))
        found += len(got)
        wanted += len(spans)
        alone += len({(k, a, b) for k in pii.KINDS for a, b in base[k]} & set(spans))
    print(f"precision {right}/{found}, recall {right}/{wanted}, patterns alone {alone}/{wanted}")
    assert right >= 0.9 * found and right >= 0.7 * wanted and right >= 2 * alone


def test_spans_against_plain_ones(spark, table):
    """The operator's rows from plain patterns, a plain Viterbi over each window and the kinds' checks."""
    model = pii.field()

    def best(rows):
        emits, paths = model.scores(rows), None
        for e in emits:
            if paths is None:
                paths = [(s + e[k], [k]) for k, s in enumerate(model.first)]
            else:
                paths = [max(((v + model.step[i, k] + e[k], [*p, k]) for i, (v, p) in enumerate(paths)), key=lambda x: x[0]) for k in range(len(e))]
        return max(paths, key=lambda x: x[0])[1]

    got = {r["doc_id"]: (r["base_sha256"], r["spans"], [r[f"n_{k}"] for k in pii.KINDS]) for r in pii.found(table).collect()}
    for doc_id, text in ordered_rows(table):
        base = {k: [m.span() for m in re.finditer(p, text) if good(m.group())] for k, (p, good) in PLAIN.items()}
        every = {k: list(v) for k, v in base.items()}
        for a, b in pii.windows(text) if len(text) < 6000 else []:
            words = [(a + m.start(), a + m.end()) for m in pii.WORD.finditer(text[a:b])]
            for kind, x, y in pii._entities(words, np.array(best(pii.features(text, words)))):
                value = text[x:y]
                if pii.FORM[kind].fullmatch(value) and pii.CHECK[kind](value) and not any(x < e and s < y for spans in (*base.values(), every[kind]) for s, e in spans):
                    every[kind].append((x, y))
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in sorted(spans[k]))
        assert got[doc_id] == (hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), [len(base[k]) for k in pii.KINDS])


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    model = pii.Field({}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    emits = [rng.normal(size=(n, 3)) for n in (1, 4, 6)]
    for e, path in zip(emits, model.decode(emits), strict=True):
        score = lambda p, e=e: model.first[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in itertools.pairwise(p))
        assert score(path.tolist()) == pytest.approx(max(score(p) for p in itertools.product(range(3), repeat=len(e))))


# ---- 8
def plain_components(rows, width, near):
    sets = []
    for d, t in rows:
        w = t.encode().lower().split()
        sets.append((d, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    label = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= near * len(a | b):
            x, y = sorted((label[i], label[j]))
            label = [x if k == y else k for k in label]
    best = {}
    for k, (d, _) in zip(label, sets, strict=True):
        if d is not None:
            best[k] = min(best.get(k, d), d)
    return sorted((-1 if d is None else d, len(s), best.get(k, -1)) for k, (d, s) in zip(label, sets, strict=True))


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(spark, table, empty, width):
    assert minhash.near_groups(empty, folder(spark), width).count() == 0
    got = minhash.near_groups(table, folder(spark), width).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == plain_components(ordered_rows(table), width, 80)


def test_a_large_family_is_linked_as_all_pairs_would(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # hot buckets fall into many blocks
    rng = np.random.default_rng(8)
    base, rows = prose(9, 120).split(), []
    for k in range(150):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 8)):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = minhash.near_groups(spark.read.parquet(f"{tmp_path}/d"), folder(spark), 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 80)


@pytest.mark.parametrize("rare", [2, 64])
def test_texts_that_share_a_passage_are_linked_as_all_pairs_would(spark, tmp_path, monkeypatch, rare):
    """A passage with few or many own words around it: links by rare shingles, by size alone, and none."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "RARE", rare)
    passage, rows = prose(31, 60, [f"p{k}" for k in range(40)]), []
    for k in range(240):
        own = [f"w{k}x{j}" for j in range((0, 3, 5, 7, 8, 10, 12, 13, 14, 15, 16, 40)[k % 12])]
        if k % 24 >= 18:  # some share their own words with the one before
            own = [f"w{k - 12}x{j}" for j in range(len(own))] + ["more"] * (k % 2)
        half = len(own) // 2 if k % 5 == 0 else 0
        rows.append((k, " ".join([*own[:half], passage, *own[half:]])))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = minhash.near_groups(spark.read.parquet(f"{tmp_path}/d"), folder(spark), 4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(rows, 4, 80)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 499), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), folder(spark)).collect()}
    assert got == {k: 100 for k in range(101, 161)} | {k: 1 for k in range(2, 40)} | {500: 499}
    assert components.components(spark.createDataFrame([], "u long, v long"), folder(spark)).count() == 0


# ---- 9
def test_pieces_decode_and_are_best(spark, table, empty):
    model = sentencepieces.pieces(sentencepieces.default_path())
    assert sentencepieces.encoded(empty, sentencepieces.default_path()).count() == 0
    assert all(r["decodes"] for r in sentencepieces.encoded(table, sentencepieces.default_path()).collect())
    scores = {}

    def walk(node, tail):
        if node[1] >= 0:
            scores[tail] = node[2]
        for c, child in node[0].items():
            if len(tail) < 16:
                walk(child, c + tail)

    walk(model.root, "")
    rng = np.random.default_rng(4)
    words = ["▁" + "".join("thearnd€"[k] for k in rng.integers(0, 8, rng.integers(1, 9))) for _ in range(200)]
    for word, ids in model.segment_sorted(sorted(set(words))):
        best = [0.0]
        for end in range(1, len(word) + 1):
            best.append(max([best[end - 1] + model.unknown] + [best[k] + scores[word[k:end]] for k in range(end) if word[k:end] in scores]))
        raw, total, byte = b"", 0.0, {i: b for b, i in model.byte.items()}
        for i in ids:
            raw += bytes([byte[i]]) if i in byte else model.text[i].encode()
            total += 0.0 if i in byte else scores[model.text[i]]
        total += model.unknown * word.count("€") if any(i in byte for i in ids) else 0.0
        assert raw.decode() == word and total == pytest.approx(best[-1])


# ---- 10
def test_language(spark, table, empty):
    assert language_id.predict(empty).count() == 0 and language_id.known_language(empty).count() == 0
    got = {r["doc_id"]: r for r in language_id.predict(table).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (0, 1, 2))
    assert got[17]["lang_pred"] == "de" and got[14]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert {k for k, r in got.items() if r["held_out"]} == {k for k in range(len(TEXTS)) if zlib.crc32(str(k).encode()) % 4 == 2}
    left = language_id.known_language(table)
    assert left.columns == table.columns and left.count() == table.count() - 4  # no letter in the first three and in the last


def test_language_against_a_plain_kernel():
    """Kernel values from sets of n-grams, landmarks, feature map and regression written out."""
    texts = [prose(k, 20, WORDS if k % 2 else GERMAN) for k in range(14)]
    langs = ["en" if k % 2 else "de" for k in range(14)]
    model = language_id.Classifier(texts, langs, landmarks=3)

    def grams(text):
        raw = b" " + text.lower().encode() + b" "
        return {raw[k : k + n] for n in (1, 2, 3) for k in range(len(raw) - n + 1)}

    kernel = lambda x, y: len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5
    marks = [texts[k] for k in (0, 2, 4, 1, 3, 5)]
    w = np.array([[kernel(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(w)
    root = vectors / np.sqrt(values)
    of = lambda some: np.hstack([np.array([[kernel(x, y) for y in marks] for x in some]) @ root, np.ones((len(some), 1))])
    target = np.array([[1.0 if x == "de" else -1.0, 1.0 if x == "en" else -1.0] for x in langs])
    solved = np.linalg.solve(of(texts).T @ of(texts) + language_id.RIDGE * np.eye(7), of(texts).T @ target)
    asked = [prose(50 + k, 6, WORDS if k % 2 else GERMAN) for k in range(8)] + ["the und haus of", "zq ẞ 漢字"]
    want = of(asked) @ solved
    spectrum = language_id.Spectrum(model.grams)
    got = (spectrum.presence(asked) @ model.marks.T) @ model.weights + model.bias
    assert np.abs(got - want).max() < 1e-3
    found, score = model.score(spectrum, asked)
    assert found == [["de", "en"][k] for k in want.argmax(axis=1)]
    assert np.abs(score - 1 / (1 + np.exp(-4 * np.abs(want[:, 0] - want[:, 1])))).max() < 1e-2


def test_language_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    docs = shared.documents(spark, path)
    shared.session_setup(spark)
    joined = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert joined.where("lang = lang_pred").count() >= 0.97 * joined.count()
