"""Configuration: defaults, then a JSON file, then environment variables; checks, presets and modes."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from copy import deepcopy
from pathlib import Path

from lodeseek.admin.errors import ConfigInvalid

#: The defaults of each section.
DEFAULTS: dict = {
    "mode": "local",
    "vectorStore": {"backend": "parquet", "config": {"path": "./lodeseek-index"}},
    "embedding": {"provider": "transformers", "model": "Xenova/all-MiniLM-L6-v2"},
    "privacy": {"blockExternalCalls": True},
    "search": {"bm25Weight": 0.3, "vectorWeight": 0.7},
    "indexing": {"languages": [], "excludePatterns": [], "includeDocuments": True},
    "telemetry": {"enabled": False, "samplingRate": 0.1, "exporters": {"traces": "none", "metrics": "none", "logs": "none"}},
}
#: The modes, providers and remote backends of a configuration.
MODES = ("local", "cloud")
BACKENDS = ("parquet", "milvus", "zilliz", "qdrant", "chroma")
PROVIDERS = ("transformers", "openai", "voyageai")
LOCAL_BACKENDS, LOCAL_PROVIDERS = ("parquet", "milvus", "chroma"), ("transformers",)
#: Environment variable, place, type.
ENVIRONMENT = (
    ("LODESEEK_MODE", ("mode",), str),
    ("LODESEEK_VECTOR_BACKEND", ("vectorStore", "backend"), str),
    ("LODESEEK_EMBEDDING_PROVIDER", ("embedding", "provider"), str),
    ("LODESEEK_EMBEDDING_MODEL", ("embedding", "model"), str),
    ("LODESEEK_EMBEDDING_API_KEY", ("embedding", "apiKey"), str),
    ("LODESEEK_BLOCK_EXTERNAL_CALLS", ("privacy", "blockExternalCalls"), lambda x: x.strip().lower() in ("1", "true", "yes")),
)


def merged(base: Mapping, over: Mapping) -> dict:
    out = deepcopy(dict(base))
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else deepcopy(value)
    return out


def check(config: Mapping) -> list[str]:
    """Raises on missing sections and unknown values; returns warnings."""
    for section in ("mode", "vectorStore", "embedding", "privacy", "search"):
        if section not in config:
            raise ConfigInvalid(f"missing section {section}")
    for value, known, name in (
        (config["mode"], MODES, "mode"),
        (config["vectorStore"].get("backend"), BACKENDS, "vectorStore.backend"),
        (config["embedding"].get("provider"), PROVIDERS, "embedding.provider"),
    ):
        if value not in known:
            raise ConfigInvalid(f"{name} must be one of {', '.join(known)}, not {value!r}")
    weights = [config["search"].get(k) for k in ("bm25Weight", "vectorWeight")]
    if any(not isinstance(w, (int, float)) or not 0 <= w <= 1 for w in weights):
        raise ConfigInvalid("search weights must be numbers between 0 and 1")
    return [] if abs(sum(weights) - 1) < 1e-9 else [f"search weights add up to {sum(weights):g}, not 1"]


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> dict:
    """A missing file means the defaults. The environment wins."""
    config = merged(DEFAULTS, json.loads(Path(path).read_text()) if path and Path(path).exists() else {})
    env = os.environ if environ is None else environ
    for name, place, kind in ENVIRONMENT:
        if name in env:
            at = config
            for part in place[:-1]:
                at = at.setdefault(part, {})
            at[place[-1]] = kind(env[name])
    check(config)
    return config


def mode_warnings(config: Mapping) -> list[str]:
    """Settings that do not go with the mode."""
    local = config["mode"] == "local"
    backend, provider, block = config["vectorStore"]["backend"], config["embedding"]["provider"], config["privacy"].get("blockExternalCalls", False)
    found = (
        (local and backend not in LOCAL_BACKENDS, f"local mode with the remote backend {backend}"),
        (local and provider not in LOCAL_PROVIDERS, f"local mode with the hosted provider {provider}"),
        (local and not block, "local mode without blocking external calls"),
        (not local and block, "cloud mode blocks external calls"),
        (not local and provider in LOCAL_PROVIDERS, f"cloud mode with the local provider {provider}"),
        (local and config["embedding"].get("local") is False, "local mode with embedding.local = false"),
        (not local and config["embedding"].get("local") is True, "cloud mode with embedding.local = true"),
    )
    return [text for wrong, text in found if wrong]


def preset(name: str, cloud: Mapping[str, str] | None = None) -> dict:
    """'local', 'quickstart' and 'performance' are alike; 'cloud' needs provider, apiKey and endpoint."""
    if name in ("local", "quickstart", "performance"):
        return deepcopy(DEFAULTS)
    if name != "cloud":
        raise ConfigInvalid(f"no preset {name}")
    missing = [k for k in ("provider", "apiKey", "endpoint") if not (cloud or {}).get(k)]
    if missing:
        raise ConfigInvalid(f"cloud needs {', '.join(missing)}")
    return merged(DEFAULTS, {
        "mode": "cloud", "vectorStore": {"backend": "zilliz", "config": {"address": cloud["endpoint"]}},
        "embedding": {"provider": cloud["provider"], "apiKey": cloud["apiKey"]}, "privacy": {"blockExternalCalls": False},
    })


#: What a hosted provider embeds with unless told otherwise, and where a local server listens.
PROVIDER_MODELS = {"transformers": "Xenova/all-MiniLM-L6-v2", "openai": "text-embedding-3-small", "voyageai": "voyage-2"}
LOCAL_ADDRESS = "localhost:19530"


def build(
    mode: str = "local", backend: str = "parquet", provider: str = "transformers", path: str | None = None, address: str | None = None, token: str | None = None,
    model: str | None = None, api_key: str | None = None,
) -> tuple[dict, list[str]]:
    """(configuration, warnings) from a few answers: each backend's and provider's own settings, calls blocked in local mode."""
    for value, known, name in ((mode, MODES, "mode"), (backend, BACKENDS, "backend"), (provider, PROVIDERS, "provider")):
        if value not in known:
            raise ConfigInvalid(f"{name} must be one of {', '.join(known)}, not {value!r}")
    hosted = provider not in LOCAL_PROVIDERS
    if hosted and mode == "cloud" and not api_key:
        raise ConfigInvalid(f"cloud mode with {provider} needs an API key")
    if backend == "parquet":
        store = {"path": path or DEFAULTS["vectorStore"]["config"]["path"]}
    elif backend in LOCAL_BACKENDS:
        store = {"address": address or LOCAL_ADDRESS, "standalone": mode == "local"}
    else:
        store = {"address": address or "", "token": token or ""}
    embedding = {"provider": provider, "model": model or PROVIDER_MODELS[provider], "local": not hosted} | ({"apiKey": api_key} if hosted else {})
    out = merged(DEFAULTS, {"mode": mode, "privacy": {"blockExternalCalls": mode == "local"}})
    out |= {"vectorStore": {"backend": backend, "config": store}, "embedding": embedding}
    check(out)
    return out, mode_warnings(out)


def save(config: Mapping, path: str, overwrite: bool = False) -> None:
    check(config)
    if Path(path).exists() and not overwrite:
        raise ConfigInvalid(f"{path} exists")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config, indent=2))


def import_json(text: str) -> dict:
    try:
        config = merged(DEFAULTS, json.loads(text))
    except ValueError as error:
        raise ConfigInvalid(f"not JSON: {error}") from error
    check(config)
    return config
