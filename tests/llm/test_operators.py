"""Operators against brute force, other libraries, round trips and held-out rows."""

import hashlib
import random
import re
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from parcelgrid.llm import (
    bpe_codec, decontaminate, language, main_text, near_copies, queries, secrets, token_counts, toxicity, url_filters,
)
from tests.oracle import compare, open_duckdb

SF = "/root/testdata/sf0.001"
ALPHABETS = ["abcdefghij ", "aab ", "it's we'll I'd 'S", "the in er ▁  \n\t<s></s>0123", "日本語テキスト🙂é́ñ ΣΑΣ İ", "=-_.,;!?'\"()  ", "0"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.choice([1, 2, 5, 30, 200]))) for _ in range(n)] + [
        "".join(r.choice(a) for _ in range(r.choice([1, 5, 40, 300]))) for a in ALPHABETS for _ in range(n // 20)
    ]


def test_bpe_matches_the_library_and_streams_long_words():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    library, coder = Tokenizer.from_str(spec.decode()), bpe_codec.transducer(spec)
    r = random.Random(2)
    long = ["a" * 9_000, "ab" * 5_000, "日本語" * 2_000, "".join(r.choice("etaoinshr") for _ in range(20_000)), "x<|endoftext|>y <|startoftext|>"]
    table = [s.encode() for s in coder.surface]
    for text in random_texts(600, 1) + long:
        want = library.encode(text, add_special_tokens=False).ids
        ids = array("I", b"".join(coder.encode(text))).tolist()
        assert ids == want, text[:80]
        machine = bpe_codec.TextDecoder(table, b" ")
        cut = len(ids) // 3
        parts = machine.feed(ids[:cut]) if cut else ""
        assert parts + machine.feed(ids[cut:]) + machine.finish() == library.decode(want, skip_special_tokens=False) or not ids


def test_decoder_holds_open_characters_back():
    machine = bpe_codec.TextDecoder([b"\xe6", b"\x97\xa5", b"\xff"])
    assert [machine.feed([k]) for k in (0, 1, 2)] == ["", "日", "�"]


def test_token_counts_match_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = random_texts(1_500, 3) + ["a" * 5_000, " " * 99, "x" + " " * 33 + "y", "日本語" * 1_000, "\x00a", ""]
    got = token_counts.Counter(open(path, "rb").read())(texts)
    assert got.tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


def test_passages_match_brute_force(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["é", "日本"]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 10, 25])))) for k in range(30)]
    rows = []
    for k in range(120):
        parts = [r.choice(words + ["other", "Zz"]) for _ in range(r.randrange(60))]
        if r.random() < 0.5:
            parts[r.randrange(len(parts) + 1) : 0] = r.choice(items)[1].upper().split()
        rows.append((k, r.choice([" ", ", ", "\n- "]).join(parts)))
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    windows = {}
    for k, text in items:
        own = rule.findall(low(text))
        for at in range(max(0, len(own) - min(10, len(own)) + 1) if own else 0):
            windows.setdefault(tuple(own[at : at + 10]), set()).add(str(k))
    want = {}
    for k, text in rows:
        own, hit, found = rule.findall(low(text)), set(), set()
        for at in range(len(own)):
            for w, ids in windows.items():
                if tuple(own[at : at + len(w)]) == w:
                    hit |= set(range(at, at + len(w)))
                    found |= ids
        want[k] = (len(own), len(hit), sorted(found))
    messages = spark.createDataFrame(rows, "message_id long, content string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 400):
        got = decontaminate.find_passages(messages, bench, block_bytes=block).collect()
        assert {g.message_id: (g.n_words, sum(s.words for s in g.spans), g.items) for g in got} == want
    texts = dict(rows)
    for g in got:
        for s in g.spans:
            assert len(rule.findall(low(texts[g.message_id][s.start : s.stop]))) == s.words
    clean = decontaminate.find_passages(decontaminate.remove_passages(messages, bench).limit(200), bench)
    assert clean.count() == len(rows)


def test_index_locates_every_occurrence():
    r = np.random.default_rng(1)
    symbols = r.integers(0, 3, 400)
    starts = np.zeros(400, bool)
    starts[[0, 50, 51, 200]] = True
    index = decontaminate.FMIndex(symbols, starts, 3)
    windows = np.array([[-1, 0, 1], [2, 1, 0], [-1, -1, 2]])
    found, low, high = index.search(windows)
    run = np.cumsum(starts)
    for w, row in enumerate(windows):
        p = row[row >= 0]
        want = [k for k in range(400 - len(p) + 1) if (symbols[k : k + len(p)] == p).all() and run[k] == run[k + len(p) - 1]]
        at = np.flatnonzero(found == w)
        got = sorted(index.locate(np.arange(low[at[0]], high[at[0]])).tolist()) if len(at) else []
        assert got == want


def test_secrets_and_links(spark):
    texts = [
        'password: "abcdef" token: token: short secret=12345', "AKIA" + "A1" * 8 + " and AKIA123", "f" * 24 + " " + "e" * 23,
        "🙂 api_key = 'abc.def/ghi' " + "0a" * 15, "passwd: token: abcdefgh",
        "endpoint https://db.example.net/v1 key Zx9Abcdefghij0123456Q", "Zx9Abcdefghij0123456Q alone", "https://db.example.net alone",
        "client_id: planner-7 " + "." * 300 + " Zx9Abcdefghij0123456Q", "client_id: planner-7 " + "." * 100 + " Zx9Abcdefghij0123456Q",
    ]
    got = dict(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "message_id int, content string")).collect())
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, text in enumerate(texts):
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [tuple(s) for s in got[k] if s.kind < 3] == sorted(base)
    linked = {k: [secrets.KINDS[s.kind] for s in v if s.kind > 2] for k, v in got.items() if any(s.kind > 2 for s in v)}
    assert linked == {5: ["link_endpoint", "link_value"], 9: ["link_id", "link_value"]}
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": range(len(texts)), "text": texts}))
    cursor = con.execute(queries.ORACLES["op1_secret_scans"])
    names = [c[0] for c in cursor.description]
    spans = {r[names.index("doc_id")]: r[names.index("spans")] for r in cursor.fetchall()}
    assert spans == {k: ",".join(f"{secrets.KINDS[s.kind]}:{s.start}:{s.stop}" for s in v) for k, v in got.items()}
    clean = secrets.redact_messages(spark.createDataFrame([(1, texts[3])], "message_id int, content string")).first().content
    assert clean == "🙂 [secret]' [secret]"


def test_copies_match_brute_force(spark, monkeypatch):
    r = random.Random(9)
    centre = [r.getrandbits(64) for _ in range(12)]
    fps = set(centre)
    for c in centre:
        for _ in range(r.choice([0, 3, 40])):
            c ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(c)
    for k in range(64):
        fps |= {centre[0] ^ 1 << k, centre[0] ^ 1 << k ^ 1 << (k + 7) % 64}
    fps = sorted(fps)
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root.update({k: new for k, v in root.items() if v == old})
    signed = lambda f: f - (1 << 64) * (f >> 63)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for most in (1, 6, 10_000):
        monkeypatch.setattr(near_copies, "CELL_PAIRS", most)
        groups = {}
        for node, top in near_copies.link_components(near_copies.near_links(nodes)).collect():
            groups.setdefault(top, set()).add(node)
        want = {}
        for f, top in root.items():
            want.setdefault(top, set()).add(signed(f))
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_fingerprint():
    for text in ("", "One", "one  TWO", "a b c d", "Ä b\tc\nd e f g " * 90):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert near_copies.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lexicon_matches_edit_distance():
    terms = ["trash", "loser", "pathetic", "cad", "worthless"]
    lexicon, r = toxicity.Lexicon(terms), random.Random(4)
    for _ in range(3_000):
        word = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(word) + 1)
            word[k : k + r.randrange(2)] = r.choice(["", "x", "e"])
        word = "".join(word)
        near = [d for t in terms if (d := distance(word, t)) <= (len(t) >= 4) + (len(t) >= 8)]
        assert lexicon.match(word) == min(near, default=-1), word
    assert toxicity.Lexicon([], ["vex"]).match("vexations") == 0


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(["loser"])
    abuse, quote = toxicity.features("you are such a losr today", lexicon), toxicity.features('he called it "loser" once', lexicon)
    assert abuse[1] == 1 and abuse[3] == 1 and quote[2] == 1 and quote[0] == quote[1] == 0


def test_learned_models_on_held_out_rows(spark):
    con = open_duckdb("/root/testdata/sf0.01")
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in queries.op10_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.97
    toxic = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [r for r in queries.op3_toxicity(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.85


def test_code_lengths_are_exact():
    counts = {"a": (np.array([1, 2, 155 + 1]), np.array([3, 1, 2])), "b": (np.array([3]), np.array([1]))}
    profiles = language.profiles_from_counts(counts)
    assert np.allclose((2.0 ** -profiles.bits.astype(float)).reshape(-1, profiles.size, 2).sum(1), 1, atol=1e-5)


def test_url_sweep_matches_join_and_brute_force(spark):
    r = random.Random(8)
    hosts = [".".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rules = [(h, "/" + r.choice(["", "x", "x/y"]), r.choice(["allow", "block"])) for h in r.sample(hosts, 30)]
    urls = [(k, f"http://{r.choice(hosts)}/{r.choice(['', 'x', 'x/y/z', 'q'])}{r.choice(['', '?a', '#b'])}") for k in range(300)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    links = spark.createDataFrame(urls, "link_id int, url string").repartition(4)
    swept = {g.link_id: (g.rule, g.verdict) for g in url_filters.filter_links(links, table).collect()}
    joined = {g.link_id: (g.rule, g.verdict) for g in url_filters.filter_links(links, table, most_swept=3).collect()}
    verdicts = {}
    for h, p, v in sorted(rules, reverse=True):
        verdicts[h, p] = v
    for k, url in urls:
        host, path = re.match(r"http://([^/]*)([^?#]*)", url).groups()
        fits = [(-len(h + p), h + p, v) for (h, p), v in verdicts.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, default=(0, None, "allow"))[1:]
        assert swept[k] == joined[k] == best, url


def test_main_text_of_given_and_other_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labeller = main_text.fit_labeller(pages.filter("page_id % 2 = 0"))
    rows = pages.filter("page_id % 2 = 1")
    html_of = {r.page_id: r.html for r in rows.collect()}
    import html as references

    for r in main_text.extract_text(rows, labeller).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html_of[r.page_id], re.S)[1]
        plain = re.sub(r"<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")
        assert r.text == " ".join(references.unescape(plain).split()) and r.n_chars == len(r.text)
    odd = "<body><script>if (a<b) x('<p>')</script><!-- <p>no --><nav><a href='/'>Home</a></nav><main><h1>Ti<i>t</i>le</h1><p>One &amp; two.<p>Three&nbsp;four.</main><footer>f</footer>"
    page = spark.createDataFrame([(1, "u", odd)], "page_id int, url string, html string")
    assert main_text.extract_text(page, labeller).first().text == "Title One & two. Three four."


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), open_duckdb(SF), queries.ORACLES[name]) is None


def test_digests_are_those_of_the_ids(spark):
    out = queries.op5_bpe_codec(spark, SF).limit(5).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(open_duckdb(SF).execute("SELECT doc_id, text FROM documents").fetchall())
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
