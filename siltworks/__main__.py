"""python -m siltworks {map,scan,index,ask,chat,docs} PATH ..., serve, config {set,get,list}, cache-clear PATH."""

from __future__ import annotations

import argparse
import pathlib

CONFIG_FILE = pathlib.Path.home() / ".siltworks" / "config.json"


def _config(args: argparse.Namespace) -> None:
    from siltworks.sources.project import Config, mask

    # What is saved never holds a key that only the environment has.
    config = Config.load(CONFIG_FILE, {} if args.action == "set" else None)
    shown = lambda k: mask(config.api_key) if k == "api_key" and config.api_key else getattr(config, k)
    if args.action == "set":
        setattr(config, args.key, args.value)
        config.save(CONFIG_FILE)
    elif args.action == "get":
        print(shown(args.key))
    else:
        print("\n".join(f"{k} = {shown(k)}" for k in Config.SAVED))


def _chat(project, completer) -> None:
    """Questions from the terminal until an empty line or "exit"; earlier turns go with each."""
    history: list[tuple[str, str]] = []
    index = project.index()
    while (question := input("> ").strip()) not in ("", "exit", "quit"):
        answer = project.ask([question], completer, history=history, index=index).first().answer
        history += [("user", question), ("assistant", answer or "")]
        print(answer)


def main() -> None:
    parser = argparse.ArgumentParser(prog="siltworks")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("map", "scan", "index", "ask", "chat", "docs", "cache-clear"):
        one = commands.add_parser(name)
        one.add_argument("path")
        if name != "cache-clear":
            one.add_argument("--cache", help="folder for what stays between calls; one that all machines share. By default below the home folder")
        if name == "map":
            one.add_argument("--top", type=int, default=50)
            one.add_argument("--json", action="store_true")
        elif name == "ask":
            one.add_argument("question", nargs="+")
        elif name == "docs":
            one.add_argument("--out", default="wiki")
            one.add_argument("--form", choices=("markdown", "json", "html"), default="markdown")
            one.add_argument("--wiki-links", action="store_true")
            one.add_argument("--full", action="store_true")
        elif name == "index":
            one.add_argument("--json", help="write one nested JSON row a file to this folder")
    one = commands.add_parser("serve")
    one.add_argument("--host", default="127.0.0.1")
    one.add_argument("--port", type=int, default=8000)
    config = commands.add_parser("config").add_subparsers(dest="action", required=True)
    config.add_parser("list")
    for action in ("set", "get"):
        one = config.add_parser(action)
        one.add_argument("key", choices=("model", "api_key", "api_base", "language"))
        if action == "set":
            one.add_argument("value")
    args = parser.parse_args()
    if args.command == "config":
        return _config(args)
    from pyspark.sql import SparkSession

    from siltworks.operators import cache
    from siltworks.project import Project, content_name
    from siltworks.sources.project import Config, is_url

    spark = SparkSession.builder.appName("siltworks").config("spark.ui.enabled", "false").getOrCreate()
    if args.command == "cache-clear":
        print(f"{cache.clear(spark, args.path)} rows removed")
        return
    settings = Config.load(CONFIG_FILE)
    if args.command == "serve":
        from siltworks.server import Service, serve

        server = serve(Service(spark, settings), args.host, args.port)
        print(f"http://{args.host}:{server.server_port}/api/projects")
        return server.serve_forever()
    from siltworks.operators.completion import of_config

    completer = of_config(settings)
    kept = args.cache or str(pathlib.Path.home() / ".cache" / "siltworks" / "tables" / content_name(args.path if is_url(args.path) else str(pathlib.Path(args.path).resolve())))
    project = Project.from_path(spark, args.path, settings, exclude=(args.out.split("/")[0],) if args.command == "docs" else (), cache=kept)
    if args.command == "map":
        rows = project.map(args.top)
        print("\n".join(rows.orderBy("rank").toJSON().collect()) if args.json else rows.orderBy("rank")._show_string(args.top, False))
    elif args.command == "scan":
        project.report().show(truncate=False)
    elif args.command == "index":
        project.modules().show(100, truncate=False)
        project.totals().show()
        if args.json:
            project.indexed_files().write.mode("overwrite").json(args.json)
    elif args.command == "ask":
        project.ask([" ".join(args.question)], completer).show(truncate=False)
    elif args.command == "chat":
        _chat(project, completer)
    else:
        print(project.export(args.out, completer, form=args.form, wiki_links=args.wiki_links, full=args.full))
        print(project.usage().first().asDict())


if __name__ == "__main__":
    main()
