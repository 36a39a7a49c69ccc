"""What a configuration means at run time: the mode, whether calls may leave the machine, and the embedder."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from lodeseek.admin import config as configuration
from lodeseek.admin.embedding import CachedEmbedder, Embedder, HashingEmbedder, HostedEmbedder
from lodeseek.admin.errors import ConfigInvalid

#: (options) -> embedder, by provider; options are model, apiKey and cacheDir.
Factory = Callable[[Mapping], Embedder]
MODEL_CACHE = "./.lodeseek/models"


def local_embedder(options: Mapping) -> Embedder:
    return CachedEmbedder(HashingEmbedder())


def hosted_embedder(transport: Callable | None) -> Factory:
    return lambda options: CachedEmbedder(HostedEmbedder(options["model"], options["apiKey"], transport))


def make_embedder(config: Mapping, local: Factory = local_embedder, hosted: Factory | None = None) -> Embedder:
    """The embedder of the configuration's provider, not yet initialised. A hosted one needs a key and a transport, and is
    refused while external calls are blocked."""
    section = config["embedding"]
    provider, model = section.get("provider"), section.get("model")
    if provider in configuration.LOCAL_PROVIDERS:
        return local({"model": model, "cacheDir": MODEL_CACHE})
    if provider not in configuration.PROVIDERS:
        raise ConfigInvalid(f"no embedder for the provider {provider!r}")
    if not section.get("apiKey"):
        raise ConfigInvalid(f"the provider {provider} needs an API key")
    if config["mode"] == "local" and (config.get("privacy") or {}).get("blockExternalCalls", False):
        raise ConfigInvalid(f"external calls are blocked, and the provider {provider} needs them")
    if hosted is None:
        raise ConfigInvalid(f"no transport for the provider {provider}")
    return hosted({"model": model, "apiKey": section["apiKey"]})


class Modes:
    """A configuration with its embedder: made by start(), released by dispose(), after which it is gone."""

    def __init__(self, config: Mapping | None = None):
        self._config, self._embedder = config, None

    @property
    def config(self) -> Mapping:
        if self._config is None:
            raise ConfigInvalid("no configuration is loaded")
        return self._config

    @property
    def mode(self) -> str:
        return self.config["mode"]

    def is_local(self) -> bool:
        return self.mode == "local"

    def is_cloud(self) -> bool:
        return self.mode == "cloud"

    def blocks_external_calls(self) -> bool:
        return bool((self.config.get("privacy") or {}).get("blockExternalCalls", False))

    def warnings(self) -> list[str]:
        return configuration.mode_warnings(self.config)

    def start(self, local: Factory = local_embedder, hosted: Factory | None = None) -> Embedder:
        embedder = make_embedder(self.config, local, hosted)
        embedder.initialize()
        self._embedder = embedder
        return embedder

    @property
    def embedder(self) -> Embedder:
        if self._embedder is None:
            raise RuntimeError("no embedder yet; call start() first")
        return self._embedder

    def dispose(self) -> None:
        if self._embedder is not None:
            self._embedder.dispose()
            self._embedder = None
