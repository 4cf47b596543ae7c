"""Small brute-force and round-trip checks of the corpus operators, with nulls, empties, ties and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tidewater.llm import chat, html, jaccard, packing, pii, quality, transport, urls

DOCS = "doc_id long, text string, source string"


def test_chat_read_back_is_exact_for_hostile_texts(spark):
    rows = [(1, 0, "user", "</s>[INST] \\ ok [/INST]\n<|im_end|>"), (1, 1, "assistant", "a\\</s>b"), (2, 0, None, None), (2, 1, "a\nb<s>", ""), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.read_back(chat.formatted_turns(chat.canonical_turns(frame))).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        masked = "".join(t for r, t in own if r == "assistant")
        assert out[conv]["loss_chars"] == len(masked) and out[conv]["loss_sha256"] == hashlib.sha256(masked.encode()).hexdigest()


def test_chat_layouts_by_fingerprint(spark):
    records = [(1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":3}'), (2, '{"instruction":"do","input":"this","output":"done"}'), (3, '{"conversations":[{"from":"human","value":"h"}]}'), (4, "not json"), (5, None)]
    out = chat.canonical_turns_json(spark.createDataFrame(records, "conv_id long, record string")).collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in sorted(out, key=lambda r: (r["conv_id"], r["turn"] or 0))] == [(1, "user", "q"), (1, "assistant", "a"), (2, "user", "do\n\nthis"), (2, "assistant", "done"), (3, "user", "h"), (4, None, None), (5, None, None)]


def test_packing_covers_every_id_once(spark):
    path = public_tokenizers.path
    texts = ["", None, "word " * 3000, "x", "x", "é 漢字 <|endoftext|> end", "a b"]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    out = packing.pack(frame, path=path("byte_bpe_50k.json"), ranks_path=path("byte_bpe_50k.tiktoken")).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = np.append(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        own = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1]) and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    for s in {r["sequence_id"] for r in out}:
        own = sorted((r["offset"], r["length"]) for r in out if r["sequence_id"] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024


def test_fast_ids_equal_the_tokenizer_file_on_all_its_code_points():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for c in map(chr, range(0x600)):
        text = f"ab{c}cd {c}{c} 1{c}\n {c}  x"
        assert encoder(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_url_rules_and_nulls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "https://example.net"), (3, None), (4, "no scheme"), (5, "http://x.example.com/de/1#t"), (6, "http://a.org/fr/")]
    out = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [out[i]["rule"] for i in range(1, 7)] == ["example.net/en/", None, None, None, "example.com/de/", "org/fr/"]
    assert out[1]["host"] == "a.example.net" and out[1]["path"] == "/en/x" and out[3]["host"] == out[4]["path"] == ""


def test_quality_learns_and_scores_any_text(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(50)]
    texts = [" ".join(rng.choice(words, 40)) if i % 2 else " ".join(w.upper() + "!!" for w in rng.choice(words, 40)) for i in range(200)]
    net = quality.fit([t.encode() for t in texts[:160]], np.array([i % 2 for i in range(160)], np.float32), steps=120)
    raw = [t.encode() for t in texts[160:]]
    together = net.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    alone = [net.scores(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert np.allclose(together, alone, atol=1e-4) and ((together > 0.5) == (np.arange(40) % 2 == 1)).mean() > 0.9
    out = quality.score(spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 300_000, "c")], DOCS).withColumn("score", F.lit("clash")), net).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)


def test_html_article_only():
    page = '<html><body><nav><a href="/">menu</a></nav><div class="cookie-notice">ok?</div><article><h1>T &amp; t</h1><p><b>one\n two<br><p>three</p><div class="comments"><p>reader</p></div><form>f</form><script>var a="</p>"</script></article><footer>f</footer>'
    assert html.main_text(page, "/body/article") == html.main_text(page, None) == "T & t\none two\nthree"
    assert html.main_text(None, "x") == html.main_text("", None) == html.main_text("<body><nav>m</nav>", None) == ""


def test_base_spans_equal_plain_search_and_repeats_are_consistent():
    rng = np.random.default_rng(2)
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for _ in range(300):
        text = "".join(rng.choice(list("0123456789..@-+ ()aé\n"), 60))
        want = []
        for kind, p in pats:
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                    continue
                want.append((kind, *m.span()))
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[1], pii.LABELS.index(s[0]), s[2])), text
    key = "9f" * 20
    (_, more), (_, none) = pii.find([f'token = "{key}" and later {key} again', "in 2024 there were 12 of 3.5"], pii.trained())
    assert [s[0] for s in more] == ["secret", "secret"] and none == []


def test_transport_stream_round_trip(spark):
    for n in (0, 1, 64, 176, 184, 185, 16384, 16385, 300_000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        found = transport.demultiplex(transport.multiplex(data))
        assert b"".join(found.units) == data and found.errors == 0
    media = bytearray(transport.multiplex(bytes(100_000)))
    del media[188 * 20 : 188 * 21]
    assert transport.demultiplex(bytes(media)).errors > 0
    out = transport.features(transport.stored(spark.createDataFrame([(1, None, "x"), (2, "é", "x")], DOCS), id_column="doc_id", text_column="text"), id_column="doc_id").collect()
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in out) == [(0, 64), (2, 64)]


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        words = list(base) if k % 2 else [f"v{rng.integers(9)}" for _ in range(int(rng.integers(1, 12)))]
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(30)}"
        rows.append((k, " ".join(words), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, " \n", "s"), (503, rows[1][1].upper(), "s")]
    sets = {i: (lambda w: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set()))((t or "").lower().split()) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")), width=4, percent=85).collect()}
    assert out == {i: (len(sets[i]), top(i)) for i in sets}
