"""Options of a conversion, their names and parsers, and configuration files. Driver-side Python: options become literals of a plan."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# Names accepted for options, and the engines and services they stand for.
FLAVORS = ("commonmark", "gfm", "markdownlint", "hedgedoc")
FORMATS = ("markdown", "mdx", "html")
LOCAL_BACKENDS = ("none", "ollama")
MODEL_FAMILIES = {"gemini-": "gemini", "gpt-": "openai", "claude-": "anthropic"}


@dataclass(frozen=True)
class Options:
    """What to convert to, and which optional steps may run."""

    flavor: str = "commonmark"
    format: str = "markdown"
    extract_media: str | None = None
    inline_base64_media: bool = False
    ocr: str = "none"
    llm: str = "none"
    llm_model: str | None = None
    llm_endpoint: str | None = None
    restructure: bool = False
    translate: str | None = None
    report_path: str | None = None
    strict: bool = False
    config_path: str | None = None
    consent_external_send: bool = False
    llm_prompts: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, known in (("flavor", FLAVORS), ("format", FORMATS)):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if self.extract_media and self.inline_base64_media:
            raise ValueError("extract_media and inline_base64_media are mutually exclusive")

    @property
    def llm_destination(self) -> str | None:
        """Where text would be sent, as reports name it."""
        if self.llm == "none":
            return None
        return ":".join(x for x in (self.llm, self.llm_model, self.llm_endpoint) if x)


def parse_flavor(s: str) -> str | None:
    return {"commonmark": "commonmark", "CommonMark": "commonmark", "gfm": "gfm", "GFM": "gfm", "markdownlint": "markdownlint", "hedgedoc": "hedgedoc", "hackmd": "hedgedoc"}.get(s)


def parse_format(s: str) -> str | None:
    return {"md": "markdown", "markdown": "markdown", "mdx": "mdx", "html": "html"}.get(s)


def parse_ocr(s: str) -> str:
    """A known engine, or any other name, which is taken as a command."""
    return "none" if s in ("off", "none", "false") else "auto" if s in ("on", "auto", "true") else s


def parse_llm(s: str) -> dict[str, str | None]:
    """Backend, model and endpoint that a setting names: by prefix, by model family, else any compatible service."""
    if s == "none":
        return {"llm": "none", "llm_model": None, "llm_endpoint": None}
    head, colon, rest = s.partition(":")
    if colon and head in ("ollama", "gemini"):
        return {"llm": head, "llm_model": rest, "llm_endpoint": None}
    if colon and head == "openai-compatible":
        name, at, endpoint = rest.partition("@")
        return {"llm": head, "llm_model": name if at else head, "llm_endpoint": endpoint if at else rest}
    family = next((b for p, b in MODEL_FAMILIES.items() if s.startswith(p)), None)
    return {"llm": family or "openai-compatible", "llm_model": s, "llm_endpoint": None if family else ""}


def parse_config(text: str) -> dict[str, str]:
    """``key = "value"`` lines; ``#`` starts a comment line, quotes are optional, the last of equal keys wins."""
    found = {}
    for line in map(str.strip, text.splitlines()):
        key, eq, value = line.partition("=")
        if eq and not line.startswith("#"):
            found[key.strip()] = value.strip().strip('"')
    return found


def apply_config(options: Options, config: dict[str, str], folder: str = ".") -> Options:
    """``options`` with the known keys of a configuration; unknown keys and values are left alone, prompt files are found relative to it."""
    new: dict = {k: f(config[k]) or getattr(options, k) for k, f in (("flavor", parse_flavor), ("format", parse_format), ("ocr", parse_ocr)) if k in config}
    new |= parse_llm(config["llm"]) if "llm" in config else {}
    new |= {k: config[k] for k in ("extract_media", "translate") if k in config}
    new |= {k: config[k] == "true" for k in ("restructure", "strict", "inline_base64_media", "consent_external_send") if k in config}
    prompts = dict(options.llm_prompts)
    for k, v in config.items():
        task = k.removeprefix("llm.prompt_path.") if k.startswith("llm.prompt_path.") else k.removeprefix("llm_prompt_path_").replace("_", "-") if k.startswith("llm_prompt_path_") else None
        if task is not None:
            with open(os.path.join(folder, v), encoding="utf-8") as f:
                prompts[task] = f.read()
    return replace(options, **new, llm_prompts=prompts)


def load_config(path: str, options: Options = Options()) -> Options:
    with open(path, encoding="utf-8") as f:
        return replace(apply_config(options, parse_config(f.read()), os.path.dirname(path) or "."), config_path=path)


def user_config_paths(app: str = "docloom") -> list[str]:
    """Where a user's configuration may be, first match wins."""
    own, home = os.environ.get(f"{app.upper()}_HOME"), os.environ.get("HOME")
    return [os.path.join(p, "config.toml") for p in ([own] if own else [os.path.join(home, f".{app}")] if home else [])]


def apply_user_config(options: Options = Options()) -> Options:
    path = next((p for p in user_config_paths() if os.path.exists(p)), None)
    return load_config(path, options) if path else options
