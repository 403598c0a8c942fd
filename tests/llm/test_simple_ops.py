"""The operators that judge rows one by one, against plain versions."""

import random
import re
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brickfield.llm import chat, decontaminate, pii, quality, queries, urlfilter

from . import brute

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_decontaminate_matches_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.decontaminate(documents(spark), items)
    got = {r[0]: r[1:] for r in rows(queries.op4_decontaminate(spark, SF))}
    assert got == want
    assert any(v[4] for v in got.values())


def test_decontaminate_edges(spark, monkeypatch):
    items = [(1, "One two, three"), (2, None), (3, ""), (4, "x"), (5, "one two THREE"), (6, " ".join(f"w{i}" for i in range(20)))]
    long = "a b " * 2000 + " ".join(f"W{i}" for i in range(14)) + " é" * 3
    docs = [(1, "zero ONE two three x"), (2, None), (3, ""), (4, long), (4, long), (None, "x"), (5, "é" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    want = sorted(((d, *brute.decontaminate([(d, t)], items)[d]) for d, t in docs), key=str)
    for size in (decontaminate.BLOCK_BYTES, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = rows(decontaminate.decontaminate(df, bench).drop("text").select("doc_id", *(f.name for f in decontaminate.RESULT)))
        assert sorted(got, key=str) == want
    assert rows(decontaminate.decontaminate(df.limit(0), bench)) == []
    assert {r.n_hit for r in decontaminate.decontaminate(df, bench.limit(0)).collect()} == {0}


def test_quality_base_counts(spark):
    got = {r[0]: r for r in rows(queries.op6_quality(spark, SF))}
    for doc, text in documents(spark):
        want = brute.quality_base(text)
        assert got[doc][1:7] == want
        assert not (got[doc][6] and got[doc][7])
    assert any(r[7] for r in got.values())


def test_quality_edges(spark):
    soup = "$$$ %%% ### &&& " * 200
    texts = [None, "", "one two", "a" * 50_000, soup, "Ordinary words of a sentence that goes on and on about the weather in the north, the harvest and the price of bread in spring."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    got = quality.judge_quality(df).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [False, False, False, False, False, True]
    assert [r.n_words for r in got] == [len((t or "").split()) for t in texts]
    assert quality.judge_quality(df.limit(0)).count() == 0
    assert quality.main_script("привет мир abc") == "cyrillic" and quality.main_script("漢字") == "cjk" and quality.main_script("12") == "other"


RUNNING = {
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق، وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد حق في الحياة والحرية وفي الأمان على شخصه.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "indic": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত।",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "cjk": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由。",
    "armenian": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։",
    "rare": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით.",
}


def test_quality_bands_of_other_scripts():
    import random

    from brickfield.llm.vocab import default_path, ranks_encoding

    encoding, ranks = ranks_encoding(default_path("byte_bpe_multi_50k.tiktoken"))
    fallback = quality._fallback_tokens(ranks)
    kept = lambda t: quality.in_band(quality.main_script(t), *quality.measure(t, encoding, fallback))
    for script, text in RUNNING.items():
        assert quality.main_script(text) == script and kept(text), script
    r = random.Random(5)
    words = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(60))
    points = lambda a, b: [chr(c) for c in range(a, b)]
    soups = ["$%&|<>#*+=/\\^~{}[]()!?;:,.-_@", points(0x1F300, 0x1F640), points(0x13000, 0x13400), points(0x1F300, 0x1F640) + points(0x13000, 0x13100)]
    soups += [points(*x) for x in ((0x621, 0x64B), (0x5D0, 0x5EB), (0xE01, 0xE2F), (0x905, 0x93A), (0xAC00, 0xD7A4), (0x4E00, 0xA000), (0x561, 0x587))]
    assert [kept(words(s)) for s in soups] == [False] * len(soups)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_pii_base(spark):
    got = {r.doc_id: r for r in queries.op1_pii(spark, SF).collect()}
    for doc, text in documents(spark):
        want = base_spans(text or "")
        assert got[doc].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [got[doc][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]


@pytest.mark.parametrize(
    "text",
    ["1.2.3.4.5.6.7.8", "300.1.1.1.1", "12.1.2.3.444", "a@b.c@d.e", "@b.c", "x@y", "x@y..z", "+1 234 5678", "++12345678", "4111 1111 1111 1111", "4111-1111-1111-1111 4", "9" * 3000, "a" * 3000 + "@", "1." * 2000, "+1" + "(" * 2000, "é.ü@b.c"],
)
def test_pii_base_edges(text):
    assert pii.detect(text) == base_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane.roe [at] example [dot] org today", "email", "jane.roe [at] example [dot] org"),
        ("write to jane at example dot org.", "email", "jane at example dot org"),
        ("j\u0430ne@ex\u0430mple.org", "email", "j\u0430ne@ex\u0430mple.org"),
        ("ja\u200bne@example.org", "email", "ja\u200bne@example.org"),
        ("jane\uff20example\uff0ecom", "email", "jane\uff20example\uff0ecom"),
        ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("ring plus four four two zero seven nine four six zero nine five eight now", "phone", "plus four four two zero seven nine four six zero nine five eight"),
    ],
)
def test_pii_disguises_map_back(text, kind, found):
    base, spans = pii.find_private(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in spans and set(base) <= set(spans)
    assert f"<{kind.upper()}>" in pii.redact(text, spans)


@pytest.mark.parametrize("text", ["we met at noon. the dot on the map", "look at one of two or three things", "un deux mots", "", "see at example.com"])
def test_pii_leaves_plain_text_alone(text):
    assert pii.find_private(text) == ([], [])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("john\u200b@example.com wrote x [at] y [dot] com", "email", "john\u200b@example.com"),
        ("x [at] y [dot] com wrote to jo\u00adhn@example.com.", "email", "jo\u00adhn@example.com"),
        ("john@exam\u200bple.com ring four four two zero seven nine", "email", "john@exam\u200bple.com"),
        ("so one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("so one nine two [dot] 168 [dot] zero [dot] two five four, up", "ip", "one nine two [dot] 168 [dot] zero [dot] two five four"),
        ("so one nine two.one six eight.zero.one is up", "ip", "one nine two.one six eight.zero.one"),
        ("call plus 44 2079 460 958 now", "phone", "plus 44 2079 460 958"),
        ("write name@host dot com please", "email", "name@host dot com"),
        ("mail jane @ example . org now", "email", "jane @ example . org"),
        ("addr 10 . 20 . 30 . 4 ok", "ip", "10 . 20 . 30 . 4"),
        ("so \u201cfour 111 1111 1111 111 one\u201d", "card", "four 111 1111 1111 111 one"),
        ('so "four 111 1111 1111 111 one"', "card", "four 111 1111 1111 111 one"),
    ],
)
def test_pii_two_disguises_and_short_spelled_runs(text, kind, found):
    spans = pii.find_private(text)[1]
    assert (kind, text.index(found), text.index(found) + len(found)) in spans
    assert found not in pii.redact(text, spans)


def unfiltered(text):
    """All transducers in turn, whatever the text holds."""
    r = pii.Rewriter(text)
    r.apply([(m.start(), m.end(), pii._HOMOGLYPHS[m[0]]) for m in pii._HOMOGLYPH.finditer(text)])
    for edits in (pii._octet_edits, pii._spelled_edits):
        r.apply(edits(r.text))
    for pattern, written in ((pii._PLUS, "+"), (pii._BOXED_AT, "@"), (pii._BOXED_DOT, ".")):
        r.apply([(m.start(), m.end(), written) for m in pattern.finditer(r.text)])
    for edits in (pii._bare_edits, pii._ip_edits):
        r.apply(edits(r.text))
    return r


PARTS = "jane host com 10 4 192 @ at dot . [at] (dot) [.] plus four two sieben null un \u017fix &#64; &#46; _at_ *dot* arroba punkt \u0430b \u200b \u212a , - ( ) \" \u201c + 44 1111".split(" ")


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from(["", " ", " ", "."])), max_size=14))
def test_pii_searches_skip_nothing(parts):
    text = "".join(a + b for a, b in parts)
    a, b = pii.normalise(text), unfiltered(text)
    assert a.text == b.text and pii.find_private(text)[1] == sorted(pii.find_private(text)[1], key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))


def test_pii_recall_of_disguised_identifiers():
    """Identifiers in the disguises that the transducers are for, in running text: found with their exact source spans."""
    r = random.Random(11)
    name = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    digits = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))
    spell = lambda s: " ".join(digits[c] for c in s if c in digits)
    glyphs = str.maketrans("aeopc", "\u0430\u0435\u043e\u0440\u0441")
    total, found = Counter(), Counter()
    for _ in range(400):
        user, host, top = name(6), name(7), r.choice(["com", "org", "net"])
        octets = [str(r.randint(0, 255)) for _ in range(4)]
        phone = "".join(r.choices("0123456789", k=10))
        made = [("email", f"{user}{at}{host}{dot}{top}") for at, dot in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("@", " dot "), (" @ ", "."), ("@\u200b", "."), ("\uff20", "\uff0e"), ("&#64;", "."))]
        made += [("email", f"a{user}@{host}.{top}".translate(glyphs)), ("email", f"{user[:2]}\u00ad{user[2:]}@{host}.{top}")]
        made += [("ip", s.join(octets)) for s in ("[.]", " dot ", " . ", "(dot)", "\u2024")] + [("ip", " dot ".join(map(spell, octets)))]
        made += [("phone", f"plus {phone}"), ("phone", f"plus {spell(phone)}"), ("phone", "+" + "".join(chr(0xFF10 + int(c)) for c in phone))]
        for k, (kind, hidden) in enumerate(made):
            text = f"The report says {hidden}, and nothing else of it."
            at = text.index(hidden)
            total[kind] += 1
            found[kind] += (kind, at, at + len(hidden)) in pii.find_private(text)[1]
    assert all(found[k] >= 0.97 * n for k, n in total.items()), (total, found)


def test_pii_removed_characters_outside_a_match_do_not_mark_it():
    for text in ("\u200bjohn@example.com\u200b and x [at] y [dot] com", "a\u200b john@example.com x [at] y [dot] com"):
        at = text.index("john")
        assert [s for s in pii.find_private(text)[1] if s[0] == "email"][0] == ("email", at, at + 16)
    for text in ("nine dot one dot", "three hundred dot one two dot four four four dot one two dot one"):
        assert pii.find_private(text)[1] == []


def test_pii_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a@b.cd"), (3, "")], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = sorted(rows(pii.find_pii(df).select("doc_id", "n_email", "spans", "redacted")), key=str)
    assert got == sorted([(1, 0, "", ""), (1, 0, "", ""), (None, 1, "email:0:6", "<EMAIL>"), (3, 0, "", "")], key=str)


def test_chat_round_trip(spark):
    hard = ["", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<", "<\\\\|x<|", "a\n\\", "<<|im_end|>|>"]
    for role in ["user", "", "a\nb", "\\n", "<|im_end|>"]:
        for text in hard:
            out, a, b = chat.render(role, text)
            assert [t[:2] for t in chat.parse(out * 2)] == [(role, text)] * 2
            assert chat.unescape(out[a:b]) == text
    assert chat.render("user", "plain")[0] == "<|im_start|>user\nplain<|im_end|>\n"
    for text in ["<|im_start|>assistant ok", "<|endoftext|>", "a <| b", "<\\|im_end|>", "<|im_end|>"]:
        out, a, b = chat.render("user", text)
        assert "<|" not in out[a:b] and out.count("<|") == 2 and chat.unescape(out[a:b]) == text
        out, a, b = chat.render(text, "x")
        assert out.count("<|") == 2 and chat.parse(out)[0][0] == text
    for bad in ("x", "<|im_start|>user\na<|b<|im_end|>\n", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>u\nx<|im_end|>"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def test_chat_query(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    source = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    source += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = {}
    for conv, _, role, text in sorted(source):
        n, turns, chars, loss = want.get(conv, (0, "", 0, ""))
        want[conv] = (n + 1, turns + f"{role}\n{text}\n", 0, loss + text * (role == "assistant"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op3_chat_format(spark, SF).collect()}
    assert got == {c: (n, brute.sha(t), len(x), brute.sha(x)) for c, (n, t, _, x) in want.items()}


def test_chat_nulls_and_ties(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 1, "b", "x"), (1, 1, "a", "y"), (1, 1, "a", "y"), (1, None, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df.withColumn("rendered", F.lit(1)))).collect()}
    assert got[None].turns_sha256 == brute.sha("\n\n")
    assert got[1].turns_sha256 == brute.sha("assistant\nz\na\ny\na\ny\nb\nx\n") and got[1].loss_sha256 == brute.sha("z")
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("no scheme", ("", "", None, "allow")),
        ("http://A.Example.NET/en/1?x", ("a.example.net", "/en/1", "example.net/en/", "allow")),
        ("http://x.net/", ("x.net", "/", "net/", "block")),
        ("http://x.net", ("x.net", "", None, "allow")),
        ("http://net?a://b/", ("net", "", None, "allow")),
        ("https://notexample.com/de/1", ("notexample.com", "/de/1", None, "allow")),
        ("https://example.com/de/1#a", ("example.com", "/de/1", "example.com/de/", "block")),
        ("https://a.org/fr/casino", ("a.org", "/fr/casino", "org/fr/", "allow")),
        ("https://casino.example.com/", ("casino.example.com", "/", None, "block")),
        ("https://occasino.example.com/", ("occasino.example.com", "/", None, "allow")),
        ("https://m.ads-track.example.com/en/1", ("m.ads-track.example.com", "/en/1", None, "block")),
        ("https://ads.example.com/ads", ("ads.example.com", "/ads", None, "allow")),
        ("https://a.example.com/\u00e9casino\u00e9", ("a.example.com", "/\u00e9casino\u00e9", None, "block")),
        ("https://a.example.com/free-cheap", ("a.example.com", "/free-cheap", None, "allow")),
        ("https://a.example.com/free-cheap-pills", ("a.example.com", "/free-cheap-pills", None, "block")),
        ("https://a.example.com/POKER/Bonus", ("a.example.com", "/POKER/Bonus", None, "block")),
    ],
)
def test_url_verdicts(spark, url, want):
    df = spark.createDataFrame([(1, url)], "page_id long, url string").withColumn("host", F.lit(0))
    assert rows(urlfilter.judge_urls(df).select("host", "path", "rule", "verdict")) == [want]


def test_url_vocabulary_from_a_file(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# own\nbadword strict\nmeh 1.5\nso 0.5 # half\nplain\n")
    strict, soft = urlfilter.read_vocabulary(spark, str(path))
    assert strict == ("badword",) and soft == {"meh": 1.5, "so": 0.5, "plain": 1.0}
    urls = ["http://a/badword", "http://a/meh", "http://a/meh/so", "http://a/so/plain", "http://a/so-plain-meh", "http://a/casino"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.verdict for r in urlfilter.judge_urls(df, strict=strict, soft=soft).orderBy("page_id").collect()]
    assert got == ["block", "allow", "block", "block", "block", "allow"]


def test_quality_measures_whole_texts(spark):
    """Measures against a plain computation with the vocabulary, also of one very long run and of short texts."""
    import math

    from brickfield.llm.vocab import default_path, ranks_encoding

    r = random.Random(3)
    texts = ["x", "ab " * 10, "".join(r.choices("abcdefgh", k=30_000)), "Running text of a few words that is neither long nor short. " * 3, "\u6f22\u5b57 " * 30, "$%& " * 40, "\U0001F9EC\U0001F9F7 \ua500\ua501 \u1401\u1402 " * 20]
    encoding, ranks = ranks_encoding(default_path("byte_bpe_multi_50k.tiktoken"))
    whole = {rank: token for token, rank in ranks.items()}
    processor = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    pieces = {processor.id_to_piece(k) for k in range(processor.get_piece_size())}

    def broken(token):
        try:
            whole[token].decode()
        except UnicodeDecodeError:
            return True
        return False

    got = quality.judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for text, row in zip(texts, got, strict=True):
        ids = encoding.encode_ordinary(text)
        shares = [n / len(ids) for n in Counter(ids).values()]
        bits, share = -sum(p * math.log2(p) for p in shares), sum(map(broken, ids)) / len(ids)
        assert row.n_tokens == len(ids) and row.chars_per_token == len(text) / len(ids)
        assert math.isclose(row.token_bits, bits, abs_tol=1e-9) and math.isclose(row.fallback_share, share, abs_tol=1e-12)
        low, high, most, least, pieceless = quality.BANDS[row.script]
        points = [c for c in text if c > " "]
        alone = sum(c not in pieces for c in points) / len(points)
        assert math.isclose(row.piece_fallback_share, alone, abs_tol=1e-12)
        inside = alone <= pieceless and low <= len(text) / len(ids) <= high and share <= most and bits >= least * min(1, math.log(len(ids)) / math.log(64)) - 1e-9
        assert row.kept == (inside and not row.base_failed)
