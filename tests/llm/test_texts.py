"""Toxicity, fingerprints, token counts, packing, chat, pages and pieces on small tables."""

import hashlib
import itertools
import math
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash

from tessera.llm import chat, pieces, separators, simhash, toxicity, wrappers
from tessera.llm.packing import pack
from tessera.llm.queries import QUERIES
from tessera.llm.tokens import byte_bpe, default_path

ODD = [
    None, "", " ", "\n\n", "word", "a b c", "x" * 30_000, "a <|endoftext|> b", "日本語 テキスト", "tab\tand nbsp here", "▁ mark␛", "same text here now",
    "same text here now",
]


def test_segments_are_those_of_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(-0.2, 1, int(rng.integers(1, 24)))

        def maximal(lo, hi):
            """Best segment (shortest of equal ones) of a stretch, then the same on either side."""
            best = max(((s[i:j].sum(), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
            if best[0] <= 1e-12:
                return []
            return [*maximal(lo, best[2]), (best[2], best[3]), *maximal(best[3], hi)]

        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == maximal(0, len(s))
        assert sum(x[2] for x in got) == pytest.approx(sum(s[a:b].sum() for a, b in maximal(0, len(s))))
        assert all(v == pytest.approx(s[a:b].sum()) and v > 0 for a, b, v in got)
    assert toxicity.segments(np.zeros(0)) == [] and toxicity.segments(np.array([-1.0])) == []


def test_toxicity_learns_and_handles_edges(spark, docs):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("lor", "ipsu", "dolo", "amet", "cons") for b in ("a", "em", "is", "or")]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocabulary, 40))
        if bad := i % 5 == 0:
            for at in rng.integers(0, 40, 3):
                words[at] = "vile" + str(rng.choice(["st", "ness", "!", ""]))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    table = docs(rows + [(1000, None), (1001, ""), (None, "vile vilest vileness"), (3, "again")])
    known = spark.createDataFrame(labels + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table, known).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 3]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    assert [r.predicted for r in got if r.doc_id in (1000, 1001)] == [0, 0] and [r.predicted for r in got if r.doc_id is None] == [1]
    assert toxicity.toxicity(table.limit(0), known).count() == 0
    assert all(r.predicted == 0 for r in toxicity.toxicity(table, known.limit(0)).collect())
    found = toxicity.score(docs([(1, "lora " * 20 + "vilest vileness vile" + " amem" * 20)]), toxicity.fit(table, known), passages=True).first()
    assert [(p.begin, p.end) for p in found.passages] == [(20, 23)]


def test_score_against_another_program(spark, docs):
    """A text's score from words, all stretches of them, factorials and the curve, written down once more."""
    model = toxicity.Model(scores={"vile ": 2.5, "bad ": 1.7, "hate": 3.0}, other=-0.06, decay=1.2, scale=0.02, slope=1.5, length=-0.4, shift=-1.0)
    rng = np.random.default_rng(12)
    texts = ["", " ", "vile"] + [" ".join(rng.choice(
        ["vile!", "Bad", "hateful", "(hate)", "plain", "words", "of", "text"], int(rng.integers(1, 60)),
        p=[0.05, 0.05, 0.05, 0.05, 0.2, 0.2, 0.2, 0.2],
    )) for _ in range(60)]

    def score(text):
        words = [w.strip(toxicity.EDGES).lower() for w in text.split()]
        s = [2.5 if w == "vile" else 1.7 if w == "bad" else 3.0 if w.startswith("hate") and len(w) > 4 else -0.06 for w in words]

        def maximal(lo, hi):
            best = max(((sum(s[i:j]), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
            return [] if best[0] <= 1e-12 else [*maximal(lo, best[2]), best[0], *maximal(best[3], hi)]

        floor, evidence, total = math.log(max(0.02 * len(s), 1)) if s else 0, 0.0, 0.0
        for r, found in enumerate(sorted(maximal(0, len(s)), reverse=True), 1):
            if 1.2 * found <= floor:
                break
            total += 1.2 * found - floor
            evidence = max(evidence, -math.log(max(total, 1) ** (r - 1) / (math.factorial(r) * math.factorial(r - 1))) + total)
        return 1 / (1 + math.exp(-(1.5 * math.log(1 + evidence) - 0.4 * math.log(1 + len(s)) - 1.0)))

    got = {r.doc_id: r.score for r in toxicity.score(docs(list(enumerate(texts))), model).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(texts))], [score(t) for t in texts], rtol=1e-9)


def test_lambda_solves_its_equation():
    toxic, clean = np.array([0.3, 0.2, 0.5]), np.array([0.01, 0.05, 0.94])
    assert toxicity.decay_of(clean, np.log(toxic / clean)) == pytest.approx(1.0)
    scores = np.array([2.0, 1.0, -0.3])
    assert float(clean @ np.exp(toxicity.decay_of(clean, scores) * scores)) == pytest.approx(1.0)
    assert toxicity.decay_of(np.zeros(0), np.zeros(0)) == toxicity.decay_of(clean, np.ones(3)) == 1.0


def test_weak_segments_are_no_evidence():
    scorer = toxicity.Scorer(toxicity.Model(scores={"bad ": 2.0}))
    weak, strong = (0, 1, 2.0), (5, 9, 14.0)
    n = 20_000
    assert scorer.statistic(n, [weak] * 300) == 0
    assert scorer.statistic(n, [strong] + [weak] * 300) == scorer.statistic(n, [strong]) > 0
    assert scorer.statistic(n, [strong] * 40) > scorer.statistic(n, [strong] * 32)


def test_calibration_uses_all_segments(spark, monkeypatch):
    model, seen = toxicity.Model(scores={"bad ": 2.0}), []
    fit = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, n, y: seen.append((x, n)) or fit(x, n, y))
    texts = [(0, "fine word " * 30), (0, "a bad word " + "fine word " * 300), (1, ("bad " * 20 + "fine " * 900) * 60), (1, "bad bad bad bad fine")]
    toxicity._calibrate(model, spark.createDataFrame(texts, "toxic int, text string"))
    scorer = toxicity.Scorer(model)
    want = [scorer.statistic(*scorer.passages(t)) for _, t in texts]
    assert len(scorer.passages(texts[2][1])[1]) == 60
    np.testing.assert_allclose(sorted(np.expm1(seen[0][0])), sorted(want))


def test_held_out_labels_are_never_used(spark, docs):
    rows = [(i, "bad word" if zlib.crc32(str(i).encode()) % 5 == 0 else "good word") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, int(zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs(rows), labels).collect()} == {0}


def test_log_odds_are_those_of_exact_fractions():
    """Below five nodes that no clean text holds, 1 less P(toxic) would be 0 in floats; scores are those of exact fractions, clipped."""
    word, half = toxicity.tokens_of("disgusting"), toxicity.tokens_of("dismal")
    for a, b in ((4_000, 0), (160_000, 0), (4_000, 1)):
        kept = {t: (a, b) for t in word} | {t: (40, 10) for t in half if t not in word}
        model = toxicity._model(kept, 2 * a, 6 * a, (20 * a, 60 * a))
        share, drawn = Fraction(1, 4), {}
        for token in sorted(kept, key=lambda t: (t.endswith(" "), len(t))):
            above = next((drawn[token[:k]] for k in (6, 5, 4, 3) if k < len(token.strip()) and token[:k] in drawn), share)
            drawn[token] = (kept[token][0] + 2 * above) / (sum(kept[token]) + 2)
        odds = {t: math.log(p / (1 - p)) - math.log(share / (1 - share)) for t, p in drawn.items()}
        assert model.scores == pytest.approx({t: min(x, toxicity.MAX_SCORE) for t, x in odds.items()})
        assert all(model.scores[t] == toxicity.MAX_SCORE for t in word) and model.scores["dism"] < 4


def test_toxicity_of_a_sample_of_labels(spark, docs):
    """More labels than are taken, of which some 4,400 name texts with a long word that no clean text has."""
    rows = [(i, "a disgusting remark" if i % 2 else "a kind remark") for i in range(12_000)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(rows), labels, max_labelled=8_800)
    assert model.scores["disgusting "] == toxicity.MAX_SCORE and not any(t.startswith(("kin", "rem")) for t in model.scores)
    assert {(r.doc_id % 2, r.score >= 0.5) for r in toxicity.score(docs(rows), model).collect()} == {(0, False), (1, True)}


def brute_fingerprint(text):
    words = [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fifty_thousand_near_fingerprints(spark):
    """A ball of fingerprints that all link through its centre and each other: bounded memory, one component."""
    rng = np.random.default_rng(1)
    flips = np.uint64(1) << rng.integers(0, 64, (54_000, 4)).astype(np.uint64)
    fps = np.unique(np.uint64(0x1234567890ABCDEF) ^ np.bitwise_xor.reduce(flips, 1)).view(np.int64)
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"))
    parts = simhash.connected_components(edges).collect()
    assert len(parts) == len(fps) > 45_000 and len({r.component for r in parts}) == 1


@pytest.mark.parametrize("block", [2, 256])
def test_simhash_against_brute_force(spark, docs, data, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").select("text").collect()]
    base = texts[0].split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 30)]
    rows = [(i + 3, t) for i, t in enumerate(ODD + texts[:60] + near)]
    fp = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    link, comp = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, np.array([i for i, _ in rows])
    while (new := np.array([comp[r].min() for r in link])).tolist() != comp.tolist():
        comp = new
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows + [(None, "x")])).collect()}
    assert got == {i: (f"{int(f):016x}", int(c)) for (i, _), f, c in zip(rows, fp, comp)}
    assert simhash.near_duplicates(docs([])).count() == 0


def test_segments_cover_the_ball():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        ok = False
        for low, width, radius in simhash.SEGMENTS:
            mask = (1 << width) - 1
            ok |= bin((a >> low & mask) ^ (b >> low & mask)).count("1") <= radius
        assert ok
    assert sum(w for _, w, _ in simhash.SEGMENTS) == 64


def test_ids_are_the_librarys(spark, data):
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(default_path()), byte_bpe(default_path())
    texts = [t or "" for t in ODD] + [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += ["don't  we'll\t\n x²³ ½ Ⅷ٣ \u200b\ufeff\x00 'S", "a\u0301 é \U0001F468\u200d\U0001F469", " \u00a0 \u3000x", "ı İ ß ſ ǅ"]
    for text in texts:
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    library.encode_special_tokens = True
    for text in texts + ["<|endoftext|>", "a<|endoftext|><|endoftext|>b"]:
        assert ours.encode_ordinary(text).tolist() == library.encode(text, add_special_tokens=False).ids


def lengths(texts):
    return [len(byte_bpe(default_path()).encode(t or "")) for t in texts]


def test_token_counts(spark, docs):
    rows = list(enumerate(ODD + ["the quick brown fox " * 50] * 5))
    table = docs(rows).repartition(3)
    for size in (4, 64, 1 << 18):
        got = separators.scan(separators.flatten(table, end_id=50255, block_bytes=size), end_id=50255).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted(zip(range(len(rows)), lengths(t for _, t in rows)))
        assert all(r.is_ended for r in got)
    assert separators.scan(separators.flatten(docs([]))).count() == 0


def test_separator_strings_do_not_end_documents(spark, docs):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "before", "<|endoftext|><|endoftext|>end", None, "behind them all"]
    encoder = byte_bpe(default_path())
    want = [len(encoder.encode_ordinary(t or "")) for t in texts]
    assert not any((encoder.encode_ordinary(t or "") == separators.END_ID).any() for t in texts) and want[1] > 1
    for size in (4, 1 << 18):
        got = separators.scan(separators.flatten(docs(list(enumerate(texts))).coalesce(1), block_bytes=size)).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == list(enumerate(want)) and all(r.is_ended for r in got)


def test_scan_of_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separators, "CHUNK", 3)
    rng, want = np.random.default_rng(7), []
    for name in ("a.bin", "b.bin", "c.bin"):
        ids = rng.integers(0, 6, 500).astype("<u4")
        if name == "c.bin":
            ids[:] = 9
        ids.tofile(tmp_path / name)
        start = 0
        for k, end in enumerate([*np.flatnonzero(ids == 0).tolist(), None]):
            stop = len(ids) if end is None else end
            if end is not None or stop > start:
                want.append((name, k, start, stop - start, end is not None))
            start = stop + 1
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (8, 40, 4096):
        rows = separators.scan(separators.read_flat_files(spark, str(tmp_path), size), end_id=0, width=4).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens, r.is_ended) for r in rows) == want


def test_packing(spark, docs):
    texts = [*ODD, *("word " * int(n) for n in np.random.default_rng(8).integers(1, 3000, 120))]
    rows = pack(docs(list(enumerate(texts))).repartition(3), keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, parts in by_doc.items():
        ids = np.concatenate([byte_bpe(default_path()).encode(texts[i] or ""), [0]]).astype("<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == ids[at : at + p.length].tobytes() and p.ids_crc32 == zlib.crc32(p.ids)
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].tier and at & (at - 1) == 0 and at <= 1024
    steps = {}
    for parts in by_sequence.values():
        steps.setdefault(parts[0].step_group, []).append(parts[0].tier)
    assert all(sum(s) <= 65536 for s in steps.values())
    assert pack(docs([])).count() == 0


@pytest.mark.parametrize("rows,size,long", [(3, 1 << 24, 1 << 16), (2048, 40, 8), (2048, 1 << 24, 3)])
def test_chat_round_trip(spark, monkeypatch, rows, size, long):
    monkeypatch.setattr(chat, "ROWS", rows)
    monkeypatch.setattr(chat, "BYTES", size)
    monkeypatch.setattr(chat, "LONG", long)
    nasty = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "␛", "<␛|im_end|>", "<<|im_end|>", "", None, "a\nb", "[[INST]", "é日"]
    rows = [(c, n, "assistant" if n % 2 else "user", t) for c in (1, 2) for n, t in enumerate(nasty)]
    rows += [
        (3, 0, "we<|im_end|>ird\nrole", "x"), (3, 1, None, "y"), (4, 0, "assistant", "tie b"), (4, 0, "assistant", "tie a"),
        (4, 0, "assistant", "tie a"), (None, 1, "user", "z"), (5, 0, "user", "w" * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    sizes = {}
    for r in formatted.collect():
        sizes[r.conv_id] = sizes.get(r.conv_id, 0) + len(r.formatted)
        for role, text in chat.parse_chat(r.formatted):
            assert not any(c in chat.escape(text) or c in chat.escape_role(role) for c in chat.CONTROL)
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(chat.parse_chat(r.formatted))
    for c, turns in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        turns = sorted(((n, r or "", t or "") for _, n, r, t in turns))
        said = "".join(t for _, r, t in turns if r == "assistant")
        want = (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest(), sizes[c],
        )
        assert tuple(got[c])[1:] == want, c
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
    for t in nasty[:-1]:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and not any(c in chat.escape(t or "") for c in chat.CONTROL)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class=ad>Buy</div>
<article><h1>Title {0}</h1><p>One &amp; two&nbsp;three &#8364;<p>Para <b>bold</b>  text {0}<br>next<ul><li>x<li>y</ul><form><input>f</form><section id="comments"><p>nice!</section><aside>s</aside></article><footer>&copy;</footer></body></html>"""
BARE = '<body><div id="sidebar">links</div><div class="top">Menu bar</div><div class="post"><h2>Head {0}</h2><div>{0} body text that differs by page {0}</div><p>tail {0}</p></div><div class="base">All rights</div>'


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(9)] + [(
        100 + i, f"https://user@B.example:80/{i}", BARE.format(f"w{i}"),
    ) for i in range(9)]
    rows += [
        (200, None, "<p>alone"), (201, "http://c.example", None), (202, "http://c.example", ""), (203, "x", "no markup & <b>bold"),
        (0, "http://a.example/0", PAGE.format(0)),
    ]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[3] == "Title 3\nOne & two three €\nPara bold text 3 next\nx\ny"
    assert by[102] == "Head w2\nw2 body text that differs by page w2\ntail w2"
    assert (by[200], by[201], by[202], by[203]) == ("alone", "", "", "no markup & bold")
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Article(HTMLParser):
    """The article's text by another parser, for pages whose article holds nothing but headings, paragraphs and marks."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [[]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in wrappers.BLOCK:
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in wrappers.BLOCK:
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)

    def text(self):
        return "\n".join(t for t in (" ".join("".join(b).split()) for b in self.blocks) if t)


def test_pages_of_the_table_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: Article(r.html or "").text() for r in pages.collect()}
    assert {r.page_id: r.text for r in wrappers.main_text(pages).collect()} == want and len(want) > 200


def test_wrapper_inference():
    a, b = "<div><p>x</p><p>y</p><i>same</i></div>", "<div><p>z</p><hr><i>same</i></div>"
    w = wrappers.align(wrappers.fold(wrappers.tree(a)), wrappers.fold(wrappers.tree(b)))
    p, hr, i = w.children[0].children
    assert p.repeated and p.text is None and hr.optional and not i.optional and i.text == "same"


def pages_of(spark, host, *htmls):
    rows = [(i, f"http://{host}/{i}", h) for i, h in enumerate(htmls)]
    return [r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_topics_of_an_article_stay(spark):
    kept = [
        '<div class="related-work">Work {0}</div>', '<p class="notice">Notice {0}</p>', '<section class="social-history">History {0}</section>',
        '<p class="reply">Reply {0}</p>', "<menu><li>Soup {0}<li>Fish {0}</menu>", '<div class="a b c d e f g h">Many {0}</div>',
    ]
    gone = [
        '<div class="comments"><p>Comment {0}</p></div>', '<div class="comment-list">More {0}</div>', '<p class="notice cookie">Cookies {0}</p>', '<div class="adBox">Buy {0}</div>', '<div class="related-posts"><a href=x>One {0}</a></div>',
        '<div class="related"><a href=1>A {0}</a><a href=2>B {0}</a><a href=3>C {0}</a></div>', '<p class="notice">All pages say this</p>', '<menu><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Shop</a></menu>', '<form>Mail {0}</form>',
    ]
    page = lambda parts, n: "<body><article><h1>Title {0}</h1>".replace("{0}", str(n)) + "".join(p.replace("{0}", f"w{n}") for p in parts) + "<p>End</p></article></body>"
    for n, text in enumerate(pages_of(spark, "k.example", *[page(kept, n) for n in range(4)])):
        assert text == f"Title {n}\nWork w{n}\nNotice w{n}\nHistory w{n}\nReply w{n}\nSoup w{n}\nFish w{n}\nMany w{n}\nEnd"
    for part in gone:
        assert pages_of(spark, "g.example", *[page([part], n) for n in range(4)]) == [f"Title {n}\nEnd" for n in range(4)], part
    assert pages_of(spark, "one.example", page(kept, 0)) == ["Title 0\nWork w0\nNotice w0\nHistory w0\nReply w0\nSoup w0\nFish w0\nMany w0\nEnd"]
    links = "<ul>" + "".join(f"<li><a href={k}>Place {k}</a>" for k in range(6)) + "</ul>"
    assert pages_of(
        spark, "bare.example", f"<body>{links}<div><h2>Head</h2><p>{'Some words of the text. ' * 9}</p></div></body>",
    ) == ["Head\n" + ("Some words of the text. " * 9).strip()]


def test_deep_and_crooked_pages(spark):
    import time

    start = time.perf_counter()
    n = 100_000
    deep = [
        "<div>" * n + "deep" + "</div>" * n, "<span>" * n + "<p>x</p>" * 50, "<b>" * 2000 + "<li>y</b>" * 2000, "</div>" * n + "z",
        "<article>" + "<i>" * n + "in" + "</i>" * n + "</article>",
    ]
    got = pages_of(spark, "deep.example", *deep)
    assert got[0] == "deep" and got[1].split("\n") == ["x"] * 50 and got[3] == "z" and got[4] == "in" and time.perf_counter() - start < 120


def test_expressions_of_hosts(spark):
    rows = [(i, "http://e.example/", f"<body><h1>T{i}</h1>{'<p>a</p>' * (i + 1)}<i>same</i>{'<hr><em>x</em>' if i else ''}</body>") for i in range(3)]
    found = wrappers.wrappers(spark.createDataFrame(rows, "page_id long, host string, html string")).first()
    assert found.expression == "(<body>(<em></em>)?(<h1>#text</h1>)(<hr></hr>)?(<i></i>)(<p></p>)+</body>)" and found.host == "http://e.example/"


@pytest.mark.parametrize("n", [9, 40])
def test_frames_are_on_all_pages_of_a_host(spark, n):
    frame = '<body><div class="top">Menu bar</div><div class="post"><h2>Head {0}</h2><p>{0} body text of this page {0}</p>{1}</div><div class="base">All rights</div>'
    rows = [(i, f"http://b.example/{i}", frame.format(f"w{i}", "<blockquote>said once</blockquote>" if i == 3 else "")) for i in range(n)]
    rows.append((n, f"http://b.example/{n}", "<div>" * 3000 + "deep"))
    rows += [(100 + i, f"http://c.example/{i}", frame.format(f"w{i}", "<blockquote>said once</blockquote>" if i == 3 else "")) for i in range(n)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in wrappers.main_text(table.repartition(5)).collect()}
    assert "said once" in by[3] and by[n] == "deep"
    assert by[103] == "Head w3\nw3 body text of this page w3\nsaid once" and by[104] == "Head w4\nw4 body text of this page w4"
    assert by == {r.page_id: r.text for r in wrappers.main_text(table.coalesce(1)).collect()}


def test_pieces(spark, docs):
    lattice = pieces.lattice_of(pieces.default_path())

    def every(part):
        _, found = lattice.edges(part)
        def back(at):  # noqa: E306
            if at == 0:
                yield 0.0, ()
            for begin, end, piece, score in found:
                if end == at:
                    for s, ids in back(begin):
                        yield s + score, ids + tuple(lattice.ids_of(piece, part, begin))
        return sorted(back(len(part)), key=lambda x: -x[0])

    for word in ("▁hello", "▁the", "ab", "▁日x", "▁▁b", "▁aab"):
        all_ = every(word)
        got = lattice.n_best(word, 6)
        assert [s for s, _ in got] == [s for s, _ in all_[:6]] and set(got) <= set(all_) and len(set(got)) == len(got)
        score, ids, lead = next(lattice.best_of([word]))
        assert (score, tuple(ids)) in all_ and score == all_[0][0] and lead == (all_[0][0] - all_[1][0] if len(all_) > 1 else float("inf"))
    whole = every("▁ab▁the")
    encoder = pieces.Encoder(lattice, 4)
    assert [x[0] for x in encoder.encode(["ab the"])[0]] == [s for s, _ in whole[:4]]
    table = docs(list(enumerate(ODD)) + [(99, "x  y \n z ")])
    back = pieces.decode_column(pieces.encode(table, n=3)).collect()
    texts = dict(enumerate(ODD)) | {99: "x  y \n z "}
    assert back and all(r.text == (texts[r.doc_id] or "") for r in back)
    rows = {r.doc_id: r for r in pieces.digests(table).collect()}
    assert len(rows) == len(texts) and all(r.exact and r.scores == sorted(r.scores, reverse=True) for r in rows.values())
    assert pieces.encode(docs([])).count() == 0


def test_viterbi_of_many_words_at_once():
    lattice = pieces.lattice_of(pieces.default_path())
    draw = np.random.default_rng(3)
    words = sorted({"▁" * int(draw.integers(0, 2)) + "".join(draw.choice(list("abcdeinrst éщ日x\ud800\x00▁"), int(draw.integers(0, 40)))) for _ in range(3000)})
    scores, leads, counts, ids = pieces.viterbi_of(lattice).run(words)
    ends = np.cumsum(counts)
    for word, score, lead, a, b in zip(words, scores, leads, ends - counts, ends):
        want = next(lattice.best_of([word])) if word else (0.0, [], np.inf)
        assert (score, ids[a:b].tolist(), lead) == want


def as_unigram(path):
    """The library on the same pieces and scores, told that they are a unigram model: field 3 (kind) of field 2 (training) is 1."""
    import sentencepiece

    data, at = bytearray(open(path, "rb").read()), 0

    def number(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    while at < len(data):
        tag, at = number(at)
        size, at = number(at)
        if tag >> 3 == 2:
            inner, end = at, at + size
            while inner < end:
                field, inner = number(inner)
                if field >> 3 == 3:
                    data[inner] = 1
                if field & 7 == 0:
                    _, inner = number(inner)
                else:
                    n, after = number(inner) if field & 7 == 2 else (4, inner)
                    inner = after + n
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def test_best_segmentations_are_the_librarys(spark, data):
    """Scores of the n best against SentencePiece's own search over the same lattice; ids are equal where no scores tie."""
    library, lattice = as_unigram(pieces.default_path()), pieces.lattice_of(pieces.default_path())
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").select("text").collect()]
    short = [" ".join(t.split()[:8]) for t in texts if t and t.split()][:150]
    short = [t for t in short if all(c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,." for c in t)]
    assert len(short) > 40
    score_of = [library.get_score(i) for i in range(library.get_piece_size())]
    for text, ranked in zip(short, pieces.Encoder(lattice, 3).encode(short)):
        want = library.nbest_encode_as_ids(text, 3)
        scores = [sum(score_of[i] for i in ids) for ids in want]
        np.testing.assert_allclose([r[0] for r in ranked], scores, atol=1e-3)
        assert all(library.decode(np.frombuffer(r[1], "<u4").tolist()) == text and r[2] for r in ranked)
        if scores[0] > scores[1]:
            assert np.frombuffer(ranked[0][1], "<u4").tolist() == want[0]


def test_queries_keep_all_rows(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op2_toxicity", "op3_simhash", "op4_token_counts", "op6_pii", "op10_sentencepiece"):
        assert QUERIES[name](spark, data).select("doc_id").distinct().count() == n
    assert QUERIES["op8_chat_formatting"](spark, data).where("conv_id = -7").first().loss_chars == 21
    assert QUERIES["op9_html_extraction"](spark, data).count() == spark.read.parquet(f"{data}/pages.parquet").count()
