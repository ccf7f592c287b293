"""Driver-side helpers of a project: addresses, clones, names, configuration."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CLONE_MB = 500
# Variables that may hold a token for clones, in order.
TOKEN_VARIABLES = ("GITHUB_TOKEN", "GH_TOKEN")
_GIT = re.compile(r"^(?:https?://)?(?:www\.)?(github\.com|gitlab\.com|bitbucket\.org)/([^/\s]+)/([^/\s]+)$")


def parse_git_url(url: str) -> tuple[str, str, str] | None:
    """(host, owner, repo) of a repository's address."""
    m = _GIT.match(re.sub(r"\.git$", "", url.rstrip("/")))
    return m.groups() if m else None


def is_url(target: str) -> bool:
    return target.startswith("http") or parse_git_url(target) is not None


def clone_url(host: str, owner: str, repo: str, token: str | None = None) -> str:
    """With a token for github.com only."""
    login = f"x-access-token:{token}@" if token and host == "github.com" else ""
    return f"https://{login}{host}/{owner}/{repo}.git"


def dir_size_mb(folder: str | Path) -> int:
    return sum(p.lstat().st_size for p in Path(folder).rglob("*") if p.is_file()) // (1 << 20)


def fetch(url: str, cache: str | Path, token: str | None = None, force: bool = False) -> Path:
    """A shallow clone under cache/host/owner/repo; one that is there is used again. Too large ones are removed and refused.

    Without a token, the environment's (TOKEN_VARIABLES) is used.
    """
    token = token or next((os.environ[k] for k in TOKEN_VARIABLES if os.environ.get(k)), None)
    parts = parse_git_url(url)
    if parts is None:
        raise ValueError(f"not a repository address: {url}")
    folder = Path(cache, *parts)
    if force and folder.exists():
        shutil.rmtree(folder)
    if not folder.exists():
        folder.parent.mkdir(parents=True, exist_ok=True)
        done = subprocess.run(["git", "clone", "--depth", "1", "--single-branch", clone_url(*parts, token), str(folder)], capture_output=True, text=True, check=False)
        if done.returncode:
            raise RuntimeError(done.stderr.replace(token, "***") if token else done.stderr)
    if dir_size_mb(folder) > MAX_CLONE_MB:
        shutil.rmtree(folder)
        raise ValueError(f"{url} is larger than {MAX_CLONE_MB} MB")
    return folder


def guess_name(files: DataFrame, root: str) -> str:
    """The name in the first of three manifests (in the files' order) that has one; else the folder's name.

    files: ord, path, content. Only manifests at the top are read.
    """
    toml = F.replace(F.replace(F.trim(F.regexp_extract("content", r"(?m)^[ \t]*name[^=\n]*=([^=\n]*)", 1)), F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))
    package = F.replace(F.regexp_replace(F.get_json_object("content", "$.name"), "^@", ""), F.lit("/"), F.lit("-"))
    name = F.when(F.col("path") == "package.json", package).otherwise(toml)
    rows = files.where(F.col("path").isin("pyproject.toml", "package.json", "Cargo.toml")).select("ord", name.alias("name")).where("name <> ''")
    found = rows.agg(F.min_by("name", "ord")).first()[0]
    return found or Path(root).resolve().name


# Short names of models.
MODEL_ALIASES = {
    "deepseek": "deepseek/deepseek-chat", "opus": "anthropic/claude-opus-4-6", "claude": "anthropic/claude-sonnet-4-6", "gpt": "gpt-5.4", "gpt-mini": "gpt-5.4-mini",
    "gemini": "gemini/gemini-3.1-pro-preview", "gemini-flash": "gemini/gemini-2.5-flash", "qwen": "openai/qwen3.5-plus", "kimi": "openai/kimi-k2.6", "glm": "openai/glm-5", "minimax": "openai/MiniMax-M2.7",
}
# Variables that may hold a provider's key, in order; addresses of providers; the prefix of a router's keys.
KEY_VARIABLES = ("DEEPSEEK_API_KEY", "OPENROUTER_API_KEY", "OPENAI_API_KEY", "ANTHROPIC_API_KEY")
PROVIDERS = {"deepseek": "https://api.deepseek.com", "anthropic": "https://api.anthropic.com/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta"}
DEFAULT_PROVIDER, ROUTER, ROUTER_PREFIX = "https://api.openai.com/v1", "https://openrouter.ai/api/v1", "sk-or-"


def endpoint(model: str, api_key: str = "", api_base: str = "") -> tuple[str, str]:
    """(address, model name as the provider knows it). An own address or a router takes the whole name."""
    routed = api_key.startswith(ROUTER_PREFIX)
    provider, slash, rest = model.partition("/")
    base = api_base.rstrip("/") or (ROUTER if routed else PROVIDERS.get(provider, DEFAULT_PROVIDER))
    return f"{base}/chat/completions", model if api_base or routed or not slash else rest.partition("/")[0]


@dataclass
class Config:
    model: str = "offline"
    api_key: str = ""
    api_base: str = ""
    language: str = "en"
    max_file_size: int = 200 * 1024
    max_files: int = 1000
    output_dir: str = "wiki"
    concurrency: int = 5

    #: What a saved file holds.
    SAVED = ("model", "api_key", "api_base", "language")

    @classmethod
    def load(cls, path: str | Path, env: dict[str, str] | None = None, prefix: str = "SILTWORKS_") -> Config:
        """Defaults, then the file (ignored if it is no JSON), then the environment, then a provider's key; the model's short name is resolved last."""
        env = dict(os.environ) if env is None else env
        try:
            held = json.loads(Path(path).read_text())
        except (FileNotFoundError, ValueError):
            held = {}
        config = cls(**{k: v for k, v in held.items() if k in cls.SAVED and v is not None})
        for f in dataclasses.fields(cls):
            if value := env.get(prefix + f.name.upper()):
                setattr(config, f.name, int(value) if isinstance(f.default, int) else value)
        if not config.api_key:
            config.api_key = next((env[k] for k in KEY_VARIABLES if env.get(k)), "")
        config.model = MODEL_ALIASES.get(config.model, config.model)
        return config

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({k: getattr(self, k) for k in self.SAVED}, indent=2))


def mask(key: str) -> str:
    return f"{key[:8]}...{key[-4:]}" if len(key) > 12 else "***"
