import random
import re
import time

from pyspark.sql import functions as F

from turnloom.functions import rules as R
from turnloom.functions import text as X
from turnloom.operators.extract import Extractor, _draft, extract_items, fenced_blocks, mask_fences, segments
from turnloom.operators.items import dedupe_items
from turnloom.operators.context import encode
from turnloom.sources.turns import conversation_key


def found(items):
    return {(r.type, r.content, r.idx, r.strength or r.status) for r in items.collect()}


def test_beekeeping_chat_gives_one_item_per_statement(turns):
    t = turns({"hives": [
        ("user", "We're planning a second apiary beside the orchard. I'd rather keep gentle queens than heavy producers. How many frames does a nucleus want?"),
        ("assistant", "Five, as a rule; https://bees.example/nucleus has drawings."),
        ("user", "Let's adopt the Dadant boxes. Our team wants to paint them before April."),
    ]})
    assert found(encode(t)) == {
        ("fact", "We're planning a second apiary beside the orchard.", 0, None),
        ("preference", "I'd rather keep gentle queens than heavy producers.", 0, None),
        ("question", "How many frames does a nucleus want?", 0, None),
        ("reference", "https://bees.example/nucleus", 1, None),
        ("decision", "Let's adopt the Dadant boxes.", 2, "accepted"),
        ("task", "Our team wants to paint them before April.", 2, "open"),
    }


def test_strengths_of_rules_and_a_doubt_that_is_no_rule(turns):
    t = turns({"kiln": [
        ("user", "1. Avoid glazing damp clay.\n2. Each shelf has to be washed.\n* Beginners should wear goggles.\n"
                 "- Pots mustn't touch.\n• The door shouldn't be opened above 90 degrees."),
        ("assistant", "Written down."),
        ("user", "We do not remember whether cones are required to bend fully."),
    ]})
    assert {(c, s) for _, c, _, s in found(encode(t))} == {
        ("Avoid glazing damp clay.", "must_not"), ("Each shelf has to be washed.", "must"),
        ("Beginners should wear goggles.", "should"), ("Pots mustn't touch.", "must_not"),
        ("The door shouldn't be opened above 90 degrees.", "should_not"),
    }


def test_choices_are_decisions_and_the_open_one_a_task(turns):
    t = turns({"boat": [
        ("user", "I want to varnish the dinghy. There are oil and resin."),
        ("assistant", "Resin lasts, oil mends."),
        ("user", "Fine. We picked tung oil. I have decided against two coats. I'll stick with brushes from the shed."),
    ]})
    got = found(encode(t))
    assert ("task", "I want to varnish the dinghy.", 0, "open") in got
    assert sum(1 for k, _, i, s in got if (k, i, s) == ("decision", 2, "accepted")) == 3


def test_code_gives_its_language_and_no_statements(turns):
    t = turns({"loom": [
        ("user", "My project is a loom planner. Never round the thread counts. Are warps numbered from one?"),
        ("assistant", "We'll go with halves for odd counts.\n```lua lib/warp.lua\n-- you must never read this as a rule\nreturn 0.5\n```"),
    ]})
    items = encode(t).collect()
    code = [r for r in items if r.type == "code_artifact"]
    assert [(r.language, r.filename, r.confidence) for r in code] == [("lua", "lib/warp.lua", 1.0)]
    assert {(r.type, r.content, r.status) for r in items if r.type in ("decision", "constraint")} == {
        ("decision", "We'll go with halves for odd counts.", "proposed"), ("constraint", "Never round the thread counts.", None),
    }


def test_links_come_before_bare_urls_and_images_emit_nothing(turns):
    t = turns({"mixed": [("assistant", "Read https://moss.example. Then [Ferns](https://ferns.example/) ![x](https://img.example/a.png)")]})
    refs = [(r.uri, r.title) for r in extract_items(t).orderBy("rank", "seq").collect()]
    assert refs == [("https://ferns.example/", "Ferns"), ("https://moss.example", None)]


def test_spans_point_at_the_text_with_emoji_around(turns):
    text = "😀 intro 😀\nWe decided to use slate. 🎉 Every pot must be labelled.\n```py\nx = '😀'\n```\nsee https://a.example/x, ok"
    t = turns({"u": [("user", text)]})
    for r in extract_items(t).collect():
        piece = text[r.start:r.end]
        assert piece == r.content or r.type == "code_artifact" and r.content in piece
    wire = t.select(X.u16_offset(F.col("content"), F.lit(9)).alias("n")).first().n
    assert wire == len(text[:9].encode("utf-16-be")) // 2


def test_mask_keeps_length_and_newlines(spark):
    text = "a ```x\n1\n``` b 😀 ```\ny😀\n``` c ```open"
    got = spark.createDataFrame([(text,)], "content string").select(mask_fences(F.col("content"))).first()[0]
    assert len(got) == len(text) and got.count("\n") == text.count("\n") and "y" not in got and got.endswith("c ```open")


def test_boundaries_are_ascii(turns):
    got = found(encode(turns({"c": [("user", "Xmustard is good food.\nÜmust be seen here.")]})))
    assert {(k, c) for k, c, _, _ in got} == {("constraint", "Ümust be seen here.")}


def test_unicode_space_and_repeats(turns):
    t = turns({"c": [("user", "Do not use Firebase."), ("user", "do not use firebase"), ("user", "Do not use Firebase!")]})
    assert [(r.idx, r.type) for r in encode(t).collect()] == [(0, "constraint")]
    # ids hold the turn, so without the content key every statement stays
    assert dedupe_items(extract_items(t), by_content=False).count() == 3


def test_dropping_a_turn_leaves_the_others_alone(turns):
    t = turns({"c": [("user", "Every jar must be sealed."), ("user", "I prefer clay pots."), ("tool", "You must not do this.")]})
    whole = {r.item_id for r in extract_items(t).filter("idx > 0").collect()}
    assert whole == {r.item_id for r in extract_items(t.filter("idx > 0")).collect()} and len(whole) == 1


def test_ids_follow_urls(spark):
    rows = [("https://x.example/c/1#a", "t1"), ("https://x.example/c/1", "t2"), ("https://x.example/", "t1"), ("https://x.example/", "t2")]
    df = spark.createDataFrame(rows, "url string, at string")
    ids = [r[0] for r in df.select(conversation_key(F.lit("p"), F.col("url"), F.col("at"), F.lit("t"))).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_own_extractor_is_ranked_by_its_place(turns):
    def drafts(t):
        names = F.regexp_extract_all(t.prose, F.lit(r"([A-Z]{2,5}-\d+)"), F.lit(1))
        return F.transform(names, lambda m, i: _draft(seq=i, type="reference", content=m, uri=m, confidence=1.0, method="deterministic", agent="tickets@1"))

    t = turns({"c": [("user", "AB-12 must be done, see CD-3.")]})
    got = extract_items(t, [Extractor("tickets", drafts)]).collect()
    assert [(r.content, r.rank) for r in got] == [("AB-12", 0), ("CD-3", 0)]


# -- tiles ---------------------------------------------------------------------

PIECES = ["```py a.py\nx = 1\n```", "``` \n\n```", "```", "`", "\n", ". ", "? ", "!\t", "- We must go", "😀 two", "\uffff", "\ufffe0", "\ufffe", "\uffff1", "word here",
          "[l](https://a.example/x)", "![p](http://b.example/y.png)", "https://c.example/z!", "http://", "[", "](", ")", "1. item text", "end."]


def as_java(pattern):
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: chr(int(m[1], 16)), pattern).replace(r"\z", r"\Z")


def plain_blocks(text):
    return [(m.start(), m.end(), m[1].strip(), re.sub(r"\n\Z", "", m[2])) for m in re.finditer(as_java(R.FENCE), text)]


def plain_segments(text):
    ws, out, at = re.compile(as_java(X.WS)), [], 0
    for piece in re.split(f"(?<=\uffff)", re.sub(as_java(R.CUT), "\\1\uffff", text.replace("\uffff", "\ue000"))):
        piece = piece.replace("\uffff", "").replace("\ue000", "\uffff")
        lead = len(piece) - len(re.sub(f"^{ws.pattern}+", "", piece))
        body = re.sub(f"{ws.pattern}+$", "", piece[lead:])
        mark = re.match(as_java(R.LIST_MARKER), body)
        start = at + lead + (mark.end() if mark else 0)
        words = body[mark.end() if mark else 0:]
        if len(words.encode("utf-16-le")) // 2 >= R.MIN_SEGMENT and re.search(as_java(R.LETTERS), words):
            out.append((words, start, start + len(words)))
        at += len(piece)
    return out


def plain_links(text):
    links = [(m.start(), m.end(), m[1], m[3]) for m in re.finditer(as_java(R.LINK), text)]
    bare = [(m.start(), re.sub(r"[.,;:!?]+$", "", m[0])) for m in re.finditer(as_java(R.BARE_URL), text)]
    free = [(s, s + len(u), u) for s, u in bare if not any(a <= s < b for a, b, _, _ in links)]
    return [(a, b, u) for a, b, bang, u in links if not bang] + free


def test_tiles_equal_plain_patterns(spark, turns):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.choice([0, 3, 30, 700]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = df.select("i", fenced_blocks(F.col("content")).alias("b"), segments(F.col("content")).alias("s"), mask_fences(F.col("content")).alias("m")).collect()
    for r in got:
        text = texts[r.i]
        assert [(b.start, b.end, b.info, b.body) for b in r.b] == plain_blocks(text)
        assert r.m == re.sub(as_java(R.FENCE), lambda m: re.sub("[^\n]", " ", m[0]), text)
        assert [(s.text, s.start, s.end) for s in r.s] == plain_segments(text)
    items = extract_items(turns({f"c{i}": [("tool", t)] for i, t in enumerate(texts)})).filter("type = 'reference'").collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in items if r.conv_id == f"c{i}"), key=lambda r: r.seq)
        masked = re.sub(as_java(R.FENCE), lambda m: re.sub("[^\n]", " ", m[0]), text)
        assert [(r.start, r.end, r.content) for r in mine] == plain_links(masked)


def test_running_sums_over_many_blocks(spark):
    rng = random.Random(2)
    arrays = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 512, 3000)]
    rows = spark.createDataFrame(list(enumerate(arrays)), "i int, a array<int>").select("i", X.running_sums(F.col("a")).alias("s")).collect()
    for r in rows:
        assert r.s == [sum(arrays[r.i][:k]) for k in range(len(arrays[r.i]))]


def test_a_long_turn_costs_in_proportion(turns):
    """Twenty-five thousand against a hundred thousand fences, links and statements in one turn."""

    def seconds(n):
        text = "".join(f"```py a{i}.py\nx\n```\nWe decided to use jar {i}. See https://a.example/{i} and [l](https://b.example/{i}) ok.\n" for i in range(n))
        df = turns({"c": [("user", text)]})
        started = time.perf_counter()
        count = extract_items(df).count()
        assert count == 4 * n
        return time.perf_counter() - started

    seconds(100)
    small, large = seconds(25_000), seconds(100_000)
    assert large <= 8 * small  # four times the turn; a quadratic fold takes sixteen times as long
