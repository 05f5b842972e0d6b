import json
import random

from pyspark.sql import functions as F

from turnloom.operators import selection as SEL
from turnloom.operators.extract import extract_items
from turnloom.sources import pages as PG
from turnloom.sources import tree as TR
from turnloom.sources import turns as ST
from turnloom.sources.fixtures import read_recorded


def test_records_of_both_variants(spark, tmp_path):
    code = [{"language": "py", "code": "x = 1\n"}]
    picture = {"url": "blob:abc", "type": "image", "name": "p.png", "mimeType": "image/png", "dataUrl": "data:image/png;base64,AAAA"}
    one = {"source": "unknown", "platform": "kimi", "title": "T", "url": "https://k.example/c/1", "capturedAt": "yesterday", "messages": [
        {"role": "user", "content": "Hi", "codeBlocks": code, "attachments": [picture]}, {"role": "assistant", "content": "```py\nx = 1\n```", "code": code}]}
    two = {"source": "chatgpt", "title": "", "url": "", "capturedAt": "2025-01-01T00:00:00Z", "messages": [{"role": "user", "content": "├── 漢字 Ελλ 😀"}]}
    (tmp_path / "a.json").write_text(json.dumps([one, two]))
    (tmp_path / "b.json").write_text(json.dumps({"source": "x", "messages": [{"role": "wizard", "content": "?"}]}))
    (tmp_path / "c.json").write_text("not json")
    parsed = ST.parse_records(ST.read_records(spark, str(tmp_path)))
    assert sorted(r.reason for r in parsed.filter("reason is not null").collect()) == ["bad_role", "not_a_conversation"]
    turns = ST.record_turns(parsed, F.lit("2025-06-01T00:00:00.000Z"))
    got = {(r.platform, r.idx): r for r in turns.collect()}
    assert got["kimi", 0].content == "Hi\n\n```py\nx = 1\n```" and got["kimi", 1].content == "```py\nx = 1\n```"
    assert got["kimi", 0].captured_at == "2025-06-01T00:00:00.000Z" and got["kimi", 0].attachments[0].uri is None
    assert got["chatgpt", 0].content == "├── 漢字 Ελλ 😀" and got["chatgpt", 0].captured_at == "2025-01-01T00:00:00Z"
    assert {(r.code, r.n) for r in ST.record_warnings(turns).collect()} == {("captured_at_repaired", 1), ("inline_data_dropped", 1)}


def test_recorded_outputs_are_named_after_their_file(spark, tmp_path):
    (tmp_path / "c7.json").write_text("{}")
    assert [(r.conv_id, r.output) for r in read_recorded(spark, str(tmp_path)).collect()] == [("c7", "{}")]


def test_deep_tree_and_broken_links(spark):
    n = 3000
    rows = [("deep", f"n{i}", f"n{i-1}" if i else None, "user" if i % 2 else "assistant", f"m{i}") for i in range(n)]
    rows += [("deep", "spare", "n5", "user", "left out"), ("loop", "a", "b", "user", "A"), ("loop", "b", "a", "user", "B"), ("orphan", "z", "gone", "user", "Z")]
    nodes = spark.createDataFrame(rows, "conv_id string, node_id string, parent_id string, role string, content string")
    heads = spark.createDataFrame([("deep", f"n{n-1}"), ("loop", "a"), ("orphan", "z")], "conv_id string, node_id string")
    got = TR.flatten(nodes, heads).collect()
    deep = [r.content for r in sorted((r for r in got if r.conv_id == "deep"), key=lambda r: r.idx)]
    assert deep == [f"m{i}" for i in range(n)]
    assert {r.content for r in got if r.conv_id == "loop"} == {"A", "B"} and [r.content for r in got if r.conv_id == "orphan"] == ["Z"]


def test_pages(spark):
    html = (
        "<html><head><title> A &amp; B </title><script>x</script></head><body><button>Copy</button><h2>Head</h2><p>Hi <strong>all</strong> and <em>you</em> "
        "<a href='https://a.example'>link</a> <a href='javascript:x'>no</a></p><ul><li>one<ul><li>two</li></ul></li></ul><blockquote>said</blockquote>"
        "<pre><code class='hljs language-ts'>let a = 1;<br>let b;</code></pre><pre>let a = 1;\nlet b;</pre>"
        "<table><tr><th>x</th><th rowspan=2>y|z</th></tr><tr><td>1</td></tr></table><span class='katex-display'><span class='katex'><annotation encoding='application/x-tex'>a^2</annotation></span></span>"
        "<img src='https://i.example/p.png' alt='pic'><img src='/favicon.ico'><hr>Use <code>f()</code>&nbsp;end</body></html>"
    )
    read = PG.read_pages(spark.createDataFrame([(1, "u", html), (2, "u", "<p>open <b>never <p>closed" + "<div>" * 2000), (3, "u", None)], "page_id long, url string, html string"))
    got = {r.page_id: r for r in read.collect()}
    md = got[1].markdown
    assert got[1].title == "A &amp; B" and "Copy" not in md and md.startswith("## Head\n\nHi **all** and *you* [link](https://a.example) no")
    for piece in ("- one\n- two", "> said", "```ts\nlet a = 1;\nlet b;\n```", "| x | y\\|z |\n| --- | --- |\n| 1 | y\\|z |", "$$a^2$$", "![pic](https://i.example/p.png)", "---", "Use `f()` end"):
        assert piece in md, piece
    assert "favicon" not in md and got[2].markdown.startswith("open **never") and got[3].markdown == ""
    assert PG.page_code(read).count() == 1 and got[1].inline == ["f()"]


def test_selection_errors_and_strictness(spark, turns):
    t = turns({"a": [("user", f"m{i}") for i in range(6)], "b": [("user", "x")]})
    picks = spark.createDataFrame([("a", "2,5-6,2"), ("b", "1-2")], "conv_id string, selection string")
    chosen, errors = SEL.parse_selection(picks)
    kept, missing = SEL.select_turns(t, chosen)
    assert sorted(r.turn_id for r in kept.collect()) == ["a_t1", "a_t4", "a_t5"]
    assert [(r.conv_id, r.lo, r.hi) for r in missing.collect()] == [("b", 1, 1)] and errors.count() == 0


def test_endless_selections_cost_what_the_chat_has(spark, turns):
    t = turns({"a": [("user", f"m{i}") for i in range(3000)], "b": [("user", "x")]}).filter("not (conv_id = 'a' and idx = 17)")
    huge = "9" * 40
    picks = spark.createDataFrame([("a", f"1-999999999, 5-{huge}"), ("b", "001-000000000000000000000000001"), ("c", "2-4"), ("d", f"{huge}-1")], "conv_id string, selection string")
    chosen, errors = SEL.parse_selection(picks)
    assert [(r.conv_id, r.code) for r in errors.collect()] == [("d", "reversed")]
    kept, missing = SEL.select_turns(t, chosen)
    assert {r.conv_id for r in kept.collect()} == {"b"}
    assert sorted((r.conv_id, r.lo, r.hi) for r in missing.collect()) == [("a", 17, 17), ("a", 3000, 999_999_998), ("a", 3000, 10**18 - 1), ("c", 1, 3)]
    lenient, empty = SEL.select_turns_lenient(t, chosen)
    assert lenient.filter("conv_id = 'a'").count() == 2999 and [r.conv_id for r in empty.collect()] == ["c"]


def test_pages_of_several_speakers_give_turns(spark):
    html = """<html><body><main class="assistant-message-list"><h1>Sheep</h1>
      <div class="x USER-bubble y"><p>We decided to <b>shear</b> in May.</p></div>
      <div data-testid="model-turn"><div class="bot-message"><p>Use</p><pre><code class="language-sh">ls</code></pre></div><span>outside</span></div>
      <div data-role="user" class="assistant-message"></div><div data-role="user">Should the ram stay?</div>
      <div data-role="User">not marked</div><aside data-message-author-role="assistant">Yes.</aside></main></body></html>"""
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "<p>no marks</p>"), (3, "u", None)], "page_id long, url string, html string")
    turns = PG.page_turns(PG.read_pages(pages))
    got = [(r.page_id, r.idx, r.role, r.content) for r in turns.withColumnRenamed("conv_pos", "page_id").orderBy("page_id", "idx").collect()]
    assert got == [
        (1, 0, "user", "We decided to **shear** in May."), (1, 1, "assistant", "Use\n\n```sh\nls\n```"), (1, 2, "user", "Should the ram stay?"),
        (1, 3, "assistant", "Yes."), (2, 0, "assistant", "no marks"), (3, 0, "assistant", ""),
    ]
    assert {(r.type, r.role) for r in extract_items(turns).collect()} == {("decision", "user"), ("code_artifact", "assistant"), ("question", "user")}
    deep = "<div>" * 30_000 + '<p class="user-message">hi</p>' + "</div>" * 30_000
    assert PG._page(deep)["turns"] == [{"role": "user", "content": "hi"}]


def test_records_are_cut_out_of_files_by_splits(spark, tmp_path):
    """Braces, quotes and escapes in strings, arrays on one line, pretty ones, lines of objects, a file that breaks off; splits of 50 bytes."""
    rng = random.Random(7)
    bits = ["}", "{", '"', "\\", "\\\\", "[", "]", ",", "\n", "é", "🎉", "a b", "}]", '{"x":"}', "\u2028"]
    make = lambda d: {"".join(rng.choice(bits) for _ in range(rng.randrange(4))) + str(i): "".join(rng.choice(bits) for _ in range(rng.randrange(6))) if d == 0 or rng.random() < 0.6 else [make(d - 1)] * 2 for i in range(rng.randrange(4))}
    files = {f"f{i}.json": [make(2) for _ in range(rng.randrange(1, 9))] for i in range(12)}
    for i, (name, records) in enumerate(files.items()):
        text = [json.dumps(records), json.dumps(records, indent=2, ensure_ascii=False), "\n".join(map(json.dumps, records)), json.dumps(records[0])][i % 4]
        files[name] = records[:1] if i % 4 == 3 else records
        (tmp_path / name).write_text(text + ("\n" if i % 3 == 0 else ""))
    (tmp_path / "cut.json").write_text('[{"a": "x}"}, {"b": {"c": 1}')
    (tmp_path / "none.json").write_text(" []\n")
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        rows = ST.read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.pos)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.raw)
    assert got.pop("cut.json") == ['{"a": "x}"}', '{"b": {"c": 1}']
    assert {n: [json.loads(x) for x in v] for n, v in got.items()} == files
