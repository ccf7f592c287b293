from pyspark.sql import functions as F

from siltworks.project import Project
from siltworks.sources import project as helpers


def test_project(spark, tmp_path):
    tree = {
        "pyproject.toml": '[project]\nname = "demo"\n', ".gitignore": "*.tmp\n", "skip.tmp": "x", "node_modules/a.js": "x", "src/core/a.py": "import core.b\n\ndef run_it(x):\n    return x\n",
        "src/core/b.py": "def helper(y=run_it(1)):\n    return y\n", "src/web/c.py": "import core.a\nimport core.b\n\nclass Page:\n    pass\n", "README.md": "# Demo about caches\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    p = Project.from_path(spark, str(tmp_path))
    assert p.name == "demo"
    r = p.report().first()
    assert (r.candidates, r.kept) == (6, 6)
    top = p.map(3).orderBy("rank").collect()
    assert [x.path for x in top][:1] == ["src/core/b.py"] and top[0].share == 1
    assert {(x.src, x.dst) for x in p.edges().collect()} == {("src/core/a.py", "src/core/b.py"), ("src/web/c.py", "src/core/a.py"), ("src/web/c.py", "src/core/b.py")}
    assert {(x.from_symbol, x.to_symbol) for x in p.call_graph().collect()} == {("helper", "run_it")}
    assert {x.module: x.files for x in p.modules().collect()}["core"] == 2
    answer = p.ask(["caches?"]).first()
    assert "README.md" in answer.context and answer.answer
    again = p.ask(["caches?"], lambda prompt: prompt[-60:], history=[("user", "hello"), ("tool", "x"), ("assistant", "hi")]).first()
    assert again.answer.endswith("\n\nuser: hello\nassistant: hi\nQuestion: caches?")
    pages = {x.page_id: x.content for x in p.pages().collect()}
    assert {"index", "modules/core", "modules/web", "symbols"} <= set(pages) and "[`Page`](modules/web.md)" in pages["symbols"]
    plan = {x.page_id: x.action for x in p.plan(spark.createDataFrame([("gone", "x")], "page_id string, inputs string")).collect()}
    assert plan["gone"] == "removed" and plan["index"] == "written"


def test_helpers(spark, tmp_path):
    assert helpers.parse_git_url("https://gitlab.com/a/b.git/") == ("gitlab.com", "a", "b") and helpers.parse_git_url("x/y") is None
    assert helpers.clone_url("github.com", "a", "b", "t") == "https://x-access-token:t@github.com/a/b.git" and "t@" not in helpers.clone_url("gitlab.com", "a", "b", "t")
    assert helpers.mask("0123456789abcdef") == "01234567...cdef" and helpers.mask("short") == "***"
    config = helpers.Config(model="m", api_key="k", max_files=7)
    config.save(tmp_path / "c.json")
    loaded = helpers.Config.load(tmp_path / "c.json", {"SILTWORKS_MAX_FILES": "9"})
    assert (loaded.model, loaded.api_key, loaded.max_files) == ("m", "k", 9)
    files = spark.createDataFrame([(0, "package.json", '{"name": "@a/b"}'), (1, "Cargo.toml", "name = 'c'")], "ord long, path string, content string")
    assert helpers.guess_name(files, "/x/y") == "a-b" and helpers.guess_name(files.where(F.lit(False)), "/x/y") == "y"
    assert helpers.is_url("http://x") and not helpers.is_url("./x")


def test_wiki(spark, tmp_path):
    from siltworks.operators import wiki

    prompts = spark.createDataFrame([("core", "describe it"), ("web", "and this")], "key string, prompt string")
    first, put = wiki.run_pass(prompts)
    assert first.count() == put.count() == 2
    again, new = wiki.run_pass(prompts, put.select("key", "value"), completer=lambda p: "no json")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and new.isEmpty()
    failed, none = wiki.run_pass(prompts, completer=lambda p: 1 / 0)
    assert none.isEmpty() and all(r.json is None for r in failed.collect())
    pages = spark.createDataFrame([("index", "# A")], "page_id string, content string")
    assert wiki.html_site(pages, "x", str(tmp_path / "x.html")) and not wiki.html_site(pages, "x", str(tmp_path / "x.html"))
    wiki.site_loader(str(tmp_path / "site"), "x")
    assert "docsify" in (tmp_path / "site/index.html").read_text() and (tmp_path / "site/.nojekyll").exists()
    many = spark.createDataFrame([("index", "# A\n[m](modules/a.md)"), ("modules/a", "[up](../index.md)\n```mermaid\ngraph LR\n```")], "page_id string, content string")
    wiki.html_site(many, "<x>", str(tmp_path / "y.html"), "- [Overview](index.md)\n- Modules\n  - [a](modules/a.md)")
    text = (tmp_path / "y.html").read_text()
    assert text.count("showPage('modules/a')") == 2 and text.count("showPage('index')") == 2 and '<div class="mermaid">graph LR</div>' in text and "<title>&lt;x&gt;</title>" in text


def test_warm_index(spark, tmp_path):
    from siltworks.operators.retrieval import load_or_build

    files = spark.createDataFrame([("a", 7, "red fox"), ("b", 4, "blue")], "path string, size long, content string")
    load_or_build(files, "/r", str(tmp_path))
    assert load_or_build(files, "/r", str(tmp_path)).chunks.count() == 2 and len(list(tmp_path.iterdir())) == 1


def test_documents(spark, tmp_path):
    import json

    root = tmp_path / "tree"
    for name, text in {"main.py": "import core.a\n", "src/core/a.py": "from core.b import f as g, h\n\ndef run_it(x):\n    return x\n", "src/core/b.py": "def helper(y=run_it(1)):\n    return y\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    p = Project.from_path(spark, str(root))
    nested = {r.path: r for r in p.indexed_files().collect()}
    assert [(i.raw, i.resolved_path, i.symbols) for i in nested["src/core/a.py"].imports] == [("from core.b import ...", "src/core/b.py", ["f", "h"])]
    inside, outside = p.module_links()
    assert [tuple(r) for r in inside.collect()] == [("core", "src/core/a.py", "src/core/b.py")] and [tuple(r) for r in outside.collect()] == [("root", "core")]
    t = p.totals().first()
    assert (t.files, t.symbols, t.call_edges) == (3, 2, 1)
    assert [(r.from_symbol, r.to_symbol, r.depth) for r in p.flow("helper").collect()] == [("helper", "run_it", 1)]

    def answer(prompt):
        if "the project" in prompt:
            return json.dumps({"one_liner": "Small.", "tech_stack": [{"name": "Python", "version": "3", "category": "language"}]})
        if "architecture" in prompt:
            return json.dumps({"architecture_type": "layered", "components": [{"name": "core", "purpose": "rules"}]})
        if "reading order" in prompt:
            return json.dumps({"steps": [{"order": 1, "title": "Start", "files": ["main.py"]}]})
        return json.dumps({"purpose": "Rules.", "relationships": [{"source": "src/core/a.py", "target": "main.py", "description": "x"}], "files": [{"path": "main.py", "key_symbols": [{"name": "helper", "kind": "function"}]}]})

    pages, rows = p.document(answer)
    got = {r.page_id: r.content for r in pages.collect()}
    assert set(got) == {"index", "architecture", "modules/core", "modules/root", "reading-guide", "dependencies", "symbols"}
    assert "- **Python** 3 (language)" in got["index"] and "[core](modules/core.md): rules" in got["architecture"]
    head, _, tail = got["modules/core"].partition("## Internal Relationships")
    assert "[`main.py`](root.md)" in head and tail == "\n- `src/core/a.py` → `main.py`: x"
    assert rows.count() == 5 and p.progress_since(4) == [(4, "pages"), (5, "done")]
    plain = {r.page_id for r in p.document()[0].collect()}
    assert plain == set(got) - {"architecture", "reading-guide"}
    assert p.export(str(tmp_path / "j"), answer, "json") and not p.export(str(tmp_path / "j"), answer, "json")


def test_endpoint_and_tables(spark, tmp_path):
    from siltworks.operators import cache

    assert helpers.endpoint("deepseek/deepseek-chat") == ("https://api.deepseek.com/chat/completions", "deepseek-chat")
    assert helpers.endpoint("x/y", "sk-or-1") == ("https://openrouter.ai/api/v1/chat/completions", "x/y")
    assert helpers.endpoint("m", api_base="http://h/v1/") == ("http://h/v1/chat/completions", "m")
    assert helpers.Config.load(tmp_path / "none", {"OPENAI_API_KEY": "k", "SILTWORKS_MODEL": "deepseek"}).api_key == "k"
    path = str(tmp_path / "kv")
    assert cache.clear(spark, path) == 0
    cache.save_project(spark, path, "a", "{}", 1.0)
    cache.save_project(spark, path, "a", "[]", 2.0)
    assert cache.load_project(spark, path, "a") == "[]" and cache.load_project(spark, path, "b") is None
    assert cache.clear(spark, path) == 2 and spark.read.parquet(path).isEmpty()


def test_imports_and_fields_by_language(spark):
    from siltworks.operators import imports, symbols

    texts = {
        "typescript": 'import { a as b, c } from "./x"\nimport D from "y"\nconst z = require("z")\n', "rust": "use a::b::{c, d};\nmod m;\n", "go": 'import "one"\nimport (\n\t"two"\n)\nvar s = "no"\n',
        "java": "import static p.Q;\nimport p.R;\n", "python": "from a import b\nimport c\n",
    }
    rows = spark.createDataFrame([(k, k, v) for k, v in texts.items()], "path string, language string, content string")
    got = {}
    for r in imports.extract_indexed(rows).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append((r.target, r.symbols))
    assert got == {"typescript": [("./x", ["a", "c"]), ("y", ["D"]), ("z", [])], "rust": [("a::b::", ["c", "d"])], "go": [("one", []), ("two", [])], "java": [("p.Q", []), ("p.R", [])], "python": [("c", []), ("a", ["b"])]}
    point, make, free = symbols.braced_symbols("rust", "/// A point.\n\npub struct Point {\n    pub x: i32,\n    y: i32,\n}\nimpl Point {\n    fn make(mut a: i32) {}\n}\nfn free() {}\n")
    assert (point.doc_comment, point.fields, make.kind, make.params, free.kind) == ("A point.", ["x", "y"], "method", [("a", "i32")], "function")
    assert symbols.braced_symbols("go", "type Box struct {\n\tw int\n\th int\n}\n")[0].fields == ["w", "h"]


class Provider:
    """A chat endpoint on this machine that keeps what it was sent."""

    def __init__(self):
        import http.server
        import json
        import threading

        got = self.got = []

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                got.append((self.headers.get("Authorization"), body))
                bad = "fail" in body["messages"][-1]["content"]
                self.send_response(500 if bad else 200)
                self.end_headers()
                if bad:
                    self.wfile.write(b"no")
                elif body.get("stream"):
                    self.wfile.write(b'data: {"choices": [{"delta": {"content": "a "}}]}\n\n: note\ndata: {"choices": [{"delta": {"content": "b"}}]}\n\ndata: [DONE]\n\n')
                else:
                    self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"purpose": "said"}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode())

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}/v1"


def test_client_posts(spark):
    import pytest

    from siltworks.operators import completion

    provider = Provider()
    client = completion.of_config(helpers.Config(model="m", api_key="k", api_base=provider.base))
    assert client.ask("hello") == ('{"purpose": "said"}', {"prompt_tokens": 3, "completion_tokens": 2}) and "".join(client.stream("x")) == "a b"
    key, body = provider.got[0]
    assert key == "Bearer k" and body["model"] == "m" and [m["role"] for m in body["messages"]] == ["system", "user"] and {"temperature", "max_tokens"} <= set(body)
    with pytest.raises(RuntimeError, match="500: no"):
        client("fail")
    rows = spark.createDataFrame([("a", "one"), ("b", "fail")], "key string, prompt string")
    got = {r.key: r.answer for r in completion.complete(rows, client, 2).collect()}
    assert got == {"a": '{"purpose": "said"}', "b": None} and completion.of_config(helpers.Config()) is completion.offline


def test_server(spark, tmp_path):
    import json
    import threading
    import urllib.request

    from siltworks.server import Service, serve

    for name, text in {"a.py": "import b\n\ndef run():\n    return 1\n", "b.py": "def help_me():\n    return 2\n", "c.py": "x = 1\n"}.items():
        (tmp_path / name).write_text(text)
    service = Service(spark, completer=lambda prompt: '{"purpose": "fine"}')
    entry = service.start(str(tmp_path), wait=True)
    events = list(service.progress(entry))
    assert events[0] == {"step": "scan"} and {"step": "modules"} in events and events[-1] == {"status": "done"}
    assert service.handle("GET", "/api/project/ffff")[0] == 404 and service.handle("POST", "/api/scan", {})[0] == 400
    root = f"/api/project/{entry.id}"
    assert "index" in {p["id"] for p in service.handle("GET", f"{root}/pages")[1]}
    assert service.handle("GET", f"{root}/file/a.py")[1]["lines"] == 5 and service.handle("GET", f"{root}/files")[1] == {"tree": "a.py\nb.py\nc.py"}
    said = list(service.handle("POST", f"{root}/chat", {"question": "help_me", "history": [{"role": "user", "content": "hi"}]})[1])
    assert said[0]["references"][0]["path"] == "b.py" and said[1:] == [{"content": '{"purpose": "fine"}'}, {"done": True}]
    assert service.start(str(tmp_path / "none"), wait=True).status == "error"
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}{root}"))["status"] == "done"
    lines = urllib.request.urlopen(f"{base}{root}/status").read().decode().split("\n\n")
    assert lines[0] == 'data: {"step": "scan"}'
    server.shutdown()
