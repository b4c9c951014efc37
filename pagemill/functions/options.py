"""Options of jobs checked as columns or values: every fault of a row at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The limits of each class of options, as (least, whether the least itself is allowed, most).
LIMITS: dict[str, dict[str, tuple[float, bool, float | None]]] = {
    "crawl": {
        "max_pages": (0, False, None), "max_depth": (0, True, None), "concurrent_requests": (0, False, None), "timeout_seconds": (0, False, None), "min_confidence": (0, True, 1),
        "max_retries": (0, True, None), "delay_ms": (0, True, None),
    },
    "extract": {"timeout_seconds": (0, False, None), "max_concurrency": (0, False, None), "max_retries": (0, True, None), "cache_minutes": (0, False, None), "domain_interval_ms": (0, True, None)},
    "html_chunks": {"max_chunk_size": (0, False, None), "min_chunk_size": (0, False, None)},
    "reconstruct": {"quality_target": (0, True, 1), "summary_ratio": (0, False, 1), "expansion_ratio": (1, True, None), "temperature": (0, True, 2), "timeout_ms": (0, False, None)},
    "analysis": {"min_content_quality": (0, True, 1), "min_section_length": (0, False, None), "max_section_depth": (0, False, None), "timeout_ms": (0, False, None)},
    "pipeline": {"max_concurrency": (0, False, None), "total_timeout_ms": (0, False, None), "progress_interval_ms": (0, False, None)},
}
#: Options of which the first must be greater than the second.
ORDERED = {"html_chunks": (("max_chunk_size", "min_chunk_size"),)}


def _message(name: str, least: float, allowed: bool, most: float | None) -> str:
    if most is not None:
        return f"{name} must be {'from' if allowed else 'above'} {least:g} to {most:g}"
    return f"{name} must be {'at least' if allowed else 'greater than'} {least:g}"


def faults(kind: str, options: dict[str, Column]) -> Column:
    """What is wrong with a row's options of a class, in the order of the limits; options that aren't given or null are fine."""
    found = []
    for name, (least, allowed, most) in LIMITS[kind].items():
        if name in options:
            low = options[name] < least if allowed else options[name] <= least
            bad = low if most is None else low | (options[name] > most)
            found.append(F.when(bad, F.lit(_message(name, least, allowed, most))))
    for more, less in ORDERED.get(kind, ()):
        if more in options and less in options:
            found.append(F.when(options[more] <= options[less], F.lit(f"{more} must be greater than {less}")))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def checked(kind: str, **options: float) -> dict[str, float]:
    """The options, or an error that names all their faults; unknown names are faults too."""
    wrong = [f"unknown option {n}" for n in options if n not in LIMITS[kind]]
    for name, (least, allowed, most) in LIMITS[kind].items():
        value = options.get(name)
        if value is not None and (value < least if allowed else value <= least) or value is not None and most is not None and value > most:
            wrong.append(_message(name, least, allowed, most))
    wrong += [f"{a} must be greater than {b}" for a, b in ORDERED.get(kind, ()) if None not in (options.get(a), options.get(b)) and options[a] <= options[b]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return options


def all_faults(given: dict[str, dict[str, Column]]) -> Column:
    """The faults of several classes, each with the class before it."""
    def named(kind: str, columns: dict[str, Column]) -> Column:
        return F.transform(faults(kind, columns), lambda m: F.concat(F.lit(f"{kind}: "), m))

    return reduce(F.concat, [named(kind, columns) for kind, columns in given.items()])
