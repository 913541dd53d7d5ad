"""Counters and histograms of a service, and their text exposition."""

from __future__ import annotations

from bisect import bisect_left
from threading import Lock

#: Upper ends of the duration buckets, in seconds.
BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 60.0, 600.0)
#: Families: kind, labels, help.
FAMILIES: dict[str, tuple[str, tuple[str, ...], str]] = {
    "cache_hits_total": ("counter", ("namespace",), "Queries answered by the exact cache."),
    "cache_misses_total": ("counter", ("namespace",), "Queries that the exact cache could not answer."),
    "semantic_cache_hits_total": ("counter", ("namespace",), "Queries answered by a near-duplicate's result."),
    "semantic_cache_misses_total": ("counter", ("namespace",), "Opted-in queries without a near-duplicate."),
    "semantic_cache_rejections_total": ("counter", ("namespace", "reason"), "Opted-in queries that the near-duplicate cache refused."),
    "query_duration_seconds": ("histogram", ("namespace", "query_type"), "Seconds of a query, cache hits included."),
    "write_duration_seconds": ("histogram", ("namespace",), "Seconds of an upsert, import or deletion."),
    "index_build_duration_seconds": ("histogram", ("namespace", "kind"), "Seconds of an index build."),
    "compaction_duration_seconds": ("histogram", ("namespace",), "Seconds of a compaction."),
    "storage_requests_total": ("counter", ("namespace", "operation"), "Requests that went to storage, one an operation."),
    "active_namespaces": ("gauge", (), "Namespaces that this process has served."),
    "cached_handles": ("gauge", (), "Tables that this process keeps open."),
    "auth_rejections_total": ("counter", ("reason",), "Requests refused for their credentials or their rate."),
}


class Metrics:
    """Values by family and label values; ``prefix`` goes before every family's name."""

    def __init__(self, prefix: str = "skylode"):
        self.prefix = prefix
        self._values: dict[str, dict[tuple, float]] = {f: {} for f, (kind, *_) in FAMILIES.items() if kind != "histogram"}
        self._buckets: dict[str, dict[tuple, list]] = {f: {} for f, (kind, *_) in FAMILIES.items() if kind == "histogram"}
        self._lock = Lock()

    def count(self, family: str, *labels: str) -> None:
        with self._lock:
            held = self._values[family]
            held[labels] = held.get(labels, 0) + 1

    def set(self, family: str, value: float) -> None:
        with self._lock:
            self._values[family][()] = value

    def observe(self, family: str, seconds: float, *labels: str) -> None:
        with self._lock:
            own = self._buckets[family].setdefault(labels, [[0] * (len(BUCKETS) + 1), 0.0])
            own[0][bisect_left(BUCKETS, seconds)] += 1
            own[1] += seconds

    def value(self, family: str, *labels: str) -> float:
        """A counter's value, or how often a histogram was fed."""
        if family in self._values:
            return self._values[family].get(labels, 0)
        return sum(self._buckets[family].get(labels, [[0]])[0])

    def exposition(self) -> str:
        """All families in the text format that scrapers read."""
        out = []
        with self._lock:
            for family, (kind, names, text) in FAMILIES.items():
                name = f"{self.prefix}_{family}"
                out += [f"# HELP {name} {text}", f"# TYPE {name} {kind}"]
                if kind == "histogram":
                    for labels, (buckets, total) in sorted(self._buckets[family].items()):
                        below = 0
                        for end, n in zip((*BUCKETS, "+Inf"), buckets):
                            below += n
                            out.append(f"{name}_bucket{_labels((*names, 'le'), (*labels, str(end)))} {below}")
                        out += [f"{name}_sum{_labels(names, labels)} {total}", f"{name}_count{_labels(names, labels)} {below}"]
                else:
                    out += [f"{name}{_labels(names, labels)} {value:g}" for labels, value in sorted(self._values[family].items())]
        return "\n".join(out) + "\n"


def _labels(names: tuple[str, ...], values: tuple[str, ...]) -> str:
    escaped = (v.replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n") for v in values)
    return "{" + ",".join(f'{n}="{v}"' for n, v in zip(names, escaped)) + "}" if names else ""
