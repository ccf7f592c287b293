"""A folder of Markdown pages as a sink (format "page_folder"): tasks write drafts, and the commit puts them in place.

Rows are page_id, content, inputs. A page whose inputs the state file holds already is kept as it is (all are written if
`full`); pages of the state that no row has are removed. Drafts lie below .drafts, one folder an attempt of a task, so a
failed or repeated attempt leaves the export alone; an abort deletes them. The state file comes last: if a commit breaks off,
the next export finds the old state and writes again what differs. The folder must be one that all machines see.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STATE = ".state.json"


def old_state(root: Path) -> dict[str, str]:
    """Inputs by page of the last export; empty if its file is of another kind."""
    try:
        state = json.loads((root / STATE).read_text())
    except (FileNotFoundError, ValueError):
        return {}
    return state.get("pages", {}) if state.get("version") == 1 else {}


@dataclass
class _Drafted(WriterCommitMessage):
    folder: str
    written: dict[str, str]
    kept: dict[str, str]


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.full = Path(options["path"]), options.get("full", "false").lower() == "true"
        self.drafts = self.root / ".drafts" / uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        folder = self.drafts / str(TaskContext.get().taskAttemptId())
        old, root = old_state(self.root), self.root.resolve()
        written, kept = {}, {}
        for page, content, inputs in iterator:
            place = (root / f"{page}.md").resolve()
            if not place.is_relative_to(root):
                raise ValueError(f"page {page} lies outside the folder")
            if not self.full and old.get(page) == inputs and place.exists():
                kept[page] = inputs
                continue
            draft = folder / f"{page}.md"
            draft.parent.mkdir(parents=True, exist_ok=True)
            draft.write_text(content or "")
            written[page] = inputs
        return _Drafted(str(folder), written, kept)

    def commit(self, messages: list) -> None:
        told = [m for m in messages if m is not None]
        pages: dict[str, str] = {}
        for m in told:
            for page in m.written:
                place = self.root / f"{page}.md"
                place.parent.mkdir(parents=True, exist_ok=True)
                os.replace(Path(m.folder) / f"{page}.md", place)
            pages |= m.written | m.kept
        removed = sorted(set(old_state(self.root)) - set(pages))
        for page in removed:
            (self.root / f"{page}.md").unlink(missing_ok=True)
        last = {"written": sorted(p for m in told for p in m.written), "kept": sorted(p for m in told for p in m.kept), "removed": removed}
        self.root.mkdir(parents=True, exist_ok=True)
        draft = self.root / f"{STATE}.new"
        draft.write_text(json.dumps({"version": 1, "pages": pages, "last": last}))
        os.replace(draft, self.root / STATE)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Only the drafts go; also after a commit, when none is left in them."""
        shutil.rmtree(self.drafts, ignore_errors=True)
        if self.drafts.parent.exists() and not any(self.drafts.parent.iterdir()):
            self.drafts.parent.rmdir()


class PageFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def schema(self) -> str:
        return "page_id string, content string, inputs string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PageWriter(self.options)


def write_pages(pages: DataFrame, folder: str, full: bool = False) -> dict[str, list[str]]:
    """Write page_id, content, inputs below folder. Gives page ids by action, as the commit counted them."""
    pages.sparkSession.dataSource.register(PageFolder)
    pages.select("page_id", "content", "inputs").write.format("page_folder").mode("append").option("full", str(full)).save(folder)
    return json.loads((Path(folder) / STATE).read_text())["last"]
