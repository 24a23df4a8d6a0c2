"""Writers by key."""

from __future__ import annotations

from abc import ABC, abstractmethod


class Writer(ABC):
    """A sink for grids in long form. Subclasses with a key register themselves."""

    registry: dict[str, type[Writer]] = {}

    def __init_subclass__(cls, key: str | None = None, **kwargs):
        super().__init_subclass__(**kwargs)
        if key is not None:
            if key in Writer.registry:
                raise ValueError(f"there is a writer {key!r} already")
            Writer.registry[key] = cls

    @abstractmethod
    def write(self, data, meta=None, overwrite: bool = False): ...


def create_writer(key: str, **options) -> Writer:
    from isohyet.sinks import cube, tiff  # noqa: F401  (they register themselves)

    if key not in Writer.registry:
        raise ValueError(f"unknown output format {key!r}; known: {', '.join(sorted(Writer.registry))}")
    return Writer.registry[key](**options)
