from __future__ import annotations

import random

from sparline.llm.spam import LINKS, MACHINE, SENTENCE, STUFFED, WORDS, blocks, form, plain, segments, spam

PROSE = (
    "The parser reads every line of the file before it decides what to keep. If a header is missing, the reader falls back to the older form, and the "
    "caller never sees the difference. We changed this because two of the tests were slow on some machines. "
)
VOCABULARY = [a + b for a in ("par", "lin", "tok", "gra", "sto", "ren", "ver", "mod") for b in ("ser", "ked", "ing", "ate", "ful", "ous", "ment", "ion")]
GOOD = {
    "prose": PROSE * 4,
    "code": "public int readAll(File f) {\n    int n = 0;\n    while (f.next()) { n += f.size(); }\n    return n;\n}\n" * 8,
    "config": "\n".join(f"server.port.{i} = {8000 + i}" for i in range(40)),
    "log": "\n".join(f"12:00:{i % 60:02d} WARN [pool-3] waiting for lock" for i in range(60)),
    "table": "\n".join(f"readAll_{i} | {i} | 0.{i} | gradient" for i in range(40)),
    "records": "\n".join(f'{{"sku": "X-{i}", "title": "yoga mat", "cents": {i}}},' for i in range(40)),
    "links_in_sentences": " ".join(f"You can find the notes of release {i} at https://example.test/r/{i} and they say what was changed." for i in range(12)),
    "quoted_mail": "\n".join(f"> on day {i} you wrote that the build is slow" for i in range(30)),
    "tail": PROSE * 4 + "\ncheap watches, buy watches, watches online, best watches",
}
BAD = {
    "keywords": "cheap watches, buy watches online, best watches 24, watches shop, discount watches, watches outlet, " * 10,
    "lines": "\n".join(["garden chair", "cheap garden chair", "buy garden chair online", "garden chair sale"] * 10),
    "spelled": "\n".join(["g a r d e n", "ch3ap", "c​h​e​a​p", "buy n0w", "sale"] * 15),
    "links": "\n".join(f"https://shop{i}.example/deal/{i}" for i in range(30)),
    "anchors": "\n".join(f'<a href="https://a{i}.example/">running shoes</a>' for i in range(25)),
    "tags": " * ".join(f"Brandel yoga mat DS-{i} {i}.99" for i in range(40)),
    "stuffed": " ".join(f"Buy running shoes at our running shoes store, the {w} running shoes with fast shipping." for w in ["best", "cheap", "new", "top"] * 6),
    "mostly": PROSE + "\n" + "sofa cover; cheap sofa cover; sofa cover sale; buy sofa cover; " * 20,
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "clash") for i, t, lang in rows], "doc_id string, text string, lang string, n_chars int, stops string")


def test_found_and_spared(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(VOCABULARY)
    sentence = lambda: f"The {word()} of the {word()} is {word()} before we {word()} it, and that is why the {word()} was {word()}. "
    honest = [(f"h{i}", "".join(sentence() for _ in range(4 + i % 20)), "en") for i in range(60)]
    rows = [(k, t, "en") for k, t in {**GOOD, **BAD}.items()] + honest + [("copy", BAD["links"], None), ("copy2", BAD["links"], "de")]
    found = {r["doc_id"] for r in spam(frame(spark, rows)).collect()}
    assert found == {*BAD, "copy", "copy2"}


def test_null_empty_blank_and_very_long_texts(spark):
    rows = [("null", None, "en"), ("empty", "", None), ("blank", " \t\n ", "en"), ("run", "a" * 2_000_000, "en"), ("long", "cheap sofa " * 100_000, "en")]
    assert {r["doc_id"] for r in spam(frame(spark, rows)).collect()} == {"run", "long"}
    assert spam(frame(spark, [])).count() == 0


def test_forms():
    assert form("The reader is closed before the file is.") == SENTENCE
    assert form("int readAll = f(x);") == MACHINE
    assert form("https://a.example/x https://b.example/y") == LINKS
    assert form("cheap sofa cover online") == WORDS
    assert form("Buy red shoes at our red shoes store, the red shoes are here") == STUFFED


def test_segments_keep_all_text_and_blocks_all_characters():
    text = PROSE * 20 + "x" * 1000 + "\n\n" + "word " * 500
    assert "".join("".join(segments(text)).split()) == "".join(text.split())
    assert sum(sum(b.chars) for b in blocks(text)) == sum(map(len, segments(plain(text))))
    assert plain("c h e a p s​o​fa") == "cheap sofa"


def test_tags_are_spam_and_lines_that_begin_like_tags_are_not(spark):
    names = ["travel_bag_shipping", "lock_app_shop", "timeoutappAskado", "wrist_watch", "yogamatVelmor", "crédito_rápido", "sofacover", "power_drill_Kirvo"]
    tags = [f"#{a}" for a in names * 12]
    bad = {"spaced": " ".join(tags), "joined": "".join(tags), "lines": "\n".join(tags), "mostly": PROSE + "\n" + " ".join(tags), "cut": "zer_wholesale " + " ".join(tags)}
    good = {
        "preprocessor": "#include <stdio.h>\n#ifdef HAS_X\n#define readAll(f) f.all()\n#endif\n" * 12,
        "comments": "\n".join(f"#readAll_{i} is called before the lock is taken" for i in range(30)),
        "colours": "\n".join("#ffaa00 #00ffaa #abcdef #fff" for _ in range(30)),
        "members": "\n".join(f"ReaderTest#readAll_{i}" for i in range(60)),
        "styles": "#mainBox #sideBar { color: red }\n" * 40,
        "short_tail": PROSE * 4 + " ".join(tags[:6]),
    }
    found = {r["doc_id"] for r in spam(frame(spark, [(k, t, "en") for k, t in {**bad, **good}.items()])).collect()}
    assert found == {*bad}
    assert form("#travel_bag_shipping#lock_app_shop#timeoutappAskado#") == WORDS
    assert form("#ifdef HAS_X") == form("# readAll is called") == MACHINE


def test_words_spelled_next_to_each_other_are_not_identifiers(spark):
    spelled = "bonus U h r e n   k a u f e n H a n d y h ü l l e   b i l l i g cheap Uhren k@ufen U h r e n   k a u f e n d3al "
    honest = "int readAll = f(x);\n" * 40
    assert {r["doc_id"] for r in spam(frame(spark, [("spelled", spelled * 12, "de"), ("code", honest, "en"), ("prose", PROSE * 4, "en")])).collect()} == {"spelled"}


def test_words_in_blocks_with_sentence_ends_of_usual_redundancy_do_not_count(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(VOCABULARY)
    texts = [("short", "".join(f"{word().title()} {word()}. " for _ in range(60)), "en")]
    texts += [(f"h{i}", "".join(f"The {word()} of the {word()} is {word()} before we {word()} it. " for _ in range(20)), "en") for i in range(60)]
    assert spam(frame(spark, texts)).count() == 0
