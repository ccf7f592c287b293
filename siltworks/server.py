"""HTTP routes over projects: scan, progress, pages, files, graph, chat. JSON, and event streams where things take time."""

from __future__ import annotations

import dataclasses
import json
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from siltworks.operators import completion
from siltworks.project import Project
from siltworks.sources.project import Config

#: Origins that browsers may call from.
ORIGINS = ("http://localhost:5173", "http://localhost:3000", "http://127.0.0.1:5173")


@dataclasses.dataclass
class Entry:
    """What the server knows of a project; done is set when its scan has ended, well or not."""

    id: str
    path: str
    status: str = "scanning"
    error: str = ""
    project: Project | None = None
    pages: dict = dataclasses.field(default_factory=dict)
    index: object = None
    steps: list = dataclasses.field(default_factory=list)
    changed: threading.Condition = dataclasses.field(default_factory=threading.Condition)

    def tell(self, step: str) -> None:
        with self.changed:
            self.steps.append(step)
            self.changed.notify_all()

    def end(self, status: str, error: str = "") -> None:
        with self.changed:
            self.status, self.error = status, error
            self.changed.notify_all()

    def info(self) -> dict:
        return {"id": self.id, "name": self.project.name if self.project else "", "path": self.path, "status": self.status} | ({"error": self.error} if self.error else {})


class _Steps(list):
    """A project's progress list that also tells an entry."""

    def __init__(self, entry: Entry):
        super().__init__()
        self.entry = entry

    def append(self, step: str) -> None:
        super().append(step)
        self.entry.tell(step)


class Service:
    """The routes without a socket: handle() takes a request and gives a status and a body, or events for a stream."""

    def __init__(self, spark, config: Config | None = None, completer: Callable | None = None):
        self.spark, self.config, self.completer = spark, config or Config(), completer
        self.entries: dict[str, Entry] = {}

    def _completer(self, key: str = "") -> Callable:
        return self.completer or completion.of_config(dataclasses.replace(self.config, api_key=key) if key else self.config)

    def start(self, path: str, key: str = "", wait: bool = False) -> Entry:
        entry = Entry(uuid.uuid4().hex[:12], path)
        self.entries[entry.id] = entry
        worker = threading.Thread(target=self._scan, args=(entry, key), daemon=True)
        worker.start()
        if wait:
            worker.join()
        return entry

    def _scan(self, entry: Entry, key: str) -> None:
        try:
            entry.tell("scan")
            project = Project.from_path(self.spark, entry.path, self.config)
            project.progress = _Steps(entry)
            entry.project = project
            pages = project.document(self._completer(key))[0]
            entry.pages = {r.page_id: r.asDict() for r in pages.toLocalIterator()}
            entry.end("done")
        except Exception as e:  # noqa: BLE001  whatever ends a scan is told to the client
            entry.end("error", str(e).splitlines()[0] if str(e) else type(e).__name__)

    def progress(self, entry: Entry) -> Iterator[dict]:
        seen = 0
        while True:
            with entry.changed:
                entry.changed.wait_for(lambda: len(entry.steps) > seen or entry.status != "scanning")  # noqa: B023
                new, status = entry.steps[seen:], entry.status
            yield from ({"step": s} for s in new)
            seen += len(new)
            if status != "scanning" and seen == len(entry.steps):
                yield {"status": status}
                return

    def chat(self, entry: Entry, asked: dict, key: str = "") -> Iterator[dict]:
        """The references, then the answer piece by piece, then an end."""
        question = str(asked.get("question", ""))
        entry.index = entry.index or entry.project.index()
        yield {"references": entry.project.references(question, index=entry.index)}
        completer = self._completer(key)
        try:
            history = [(str(t.get("role", "")), str(t.get("content", ""))) for t in asked.get("history", ())]
            prompts: list[str] = []
            entry.project.ask([question], completion.offline, history=history, index=entry.index, prompts=prompts)
            pieces = completer.stream(prompts[0]) if hasattr(completer, "stream") else [completer(prompts[0])]
            for piece in pieces:
                yield {"content": piece}
        except Exception as e:  # noqa: BLE001  a provider's errors are its own
            yield {"error": str(e)}
        yield {"done": True}

    def handle(self, method: str, path: str, body: dict | None = None, key: str = "") -> tuple[int, object]:
        """(status, JSON value or iterator of events)."""
        body = body or {}
        if method == "POST" and path == "/api/scan":
            if not body.get("path"):
                return 400, {"error": "path is missing"}
            return 200, self.start(str(body["path"]), key).info()
        if method == "GET" and path == "/api/projects":
            return 200, [e.info() for e in self.entries.values()]
        m = re.fullmatch(r"/api/projects?/([0-9a-f]+)(?:/(status|pages|page|files|file|graph|chat)(?:/(.*))?)?", path)
        entry = self.entries.get(m[1]) if m else None
        if entry is None:
            return 404, {"error": "Project not found" if m else "no such route"}
        what, rest = m[2], m[3] or ""
        if what is None:
            return 200, entry.info()
        if what == "status":
            return 200, self.progress(entry)
        if entry.project is None:
            return 409, {"error": "Project not ready"}
        if what == "pages":
            return 200, [{"id": p["page_id"], "title": p["title"]} for p in entry.pages.values()]
        if what == "page":
            return (200, entry.pages[rest]) if rest in entry.pages else (404, {"error": "Page not found"})
        if what == "files":
            return 200, {"tree": entry.project.tree_text()}
        if what == "file":
            row = entry.project.file(rest).first()
            return (200, row.asDict()) if row else (404, {"error": "File not found"})
        if what == "graph":
            return 200, entry.project.graph()
        if method != "POST":
            return 405, {"error": "POST a question"}
        return 200, self.chat(entry, body, key)


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of the routes; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, told = service.handle(method, self.path.partition("?")[0], body if isinstance(body, dict) else {}, self.headers.get("x-api-key") or "")
            except ValueError:
                status, told = 400, {"error": "the body is no JSON"}
            events = not isinstance(told, (dict, list))
            self.send_response(status)
            self.send_header("Content-Type", "text/event-stream" if events else "application/json")
            if (origin := self.headers.get("Origin")) in ORIGINS:
                self.send_header("Access-Control-Allow-Origin", origin)
            self.end_headers()
            for line in (f"data: {json.dumps(e, default=str)}\n\n" for e in told) if events else (json.dumps(told, default=str),):
                self.wfile.write(line.encode())
                self.wfile.flush()

        def do_GET(self) -> None:  # noqa: N802  named by the base class
            self._answer("GET")

        def do_POST(self) -> None:  # noqa: N802
            self._answer("POST")

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.send_response(204)
            if (origin := self.headers.get("Origin")) in ORIGINS:
                for name, value in (("Origin", origin), ("Methods", "GET, POST"), ("Headers", "Content-Type, x-api-key")):
                    self.send_header(f"Access-Control-Allow-{name}", value)
            self.end_headers()

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
