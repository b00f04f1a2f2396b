"""Run settings, passed explicitly to every plan."""

from __future__ import annotations

from dataclasses import dataclass, field

# The shipped categories in code order (first code is 1) with the
# nu of their one-class model.
SHIPPED_CATEGORIES: tuple[tuple[str, float], ...] = (
    ("advertisement", 1.0),
    ("crafts", 1.0),
    ("game", 1.0),
    ("maternal", 1.0),
    ("reading", 1.0),
    ("agriculture", 1.0),
    ("decorate", 1.0),
    ("government", 1.0),
    ("medical", 1.0),
    ("social", 1.0),
    ("car", 1.0),
    ("delicacy", 1.0),
    ("immovable", 1.0),
    ("militarily", 1.0),
    ("software", 1.0),
    ("chemicalmetallurgy", 1.0),
    ("digital", 1.0),
    ("intermediary", 1.0),
    ("o2o", 1.0),
    ("travel", 1.0),
    ("clothing", 1.0),
    ("education", 1.0),
    ("logistics", 1.0),
    ("officesupplies", 1.0),
    ("wedding", 1.0),
    ("commodity", 1.0),
    ("entertainment", 1.0),
    ("manufacture", 1.0),
    ("outdoor", 1.0),
    ("complex", 0.001),
    ("finance", 1.0),
    ("massmedia", 1.0),
    ("pet", 1.0),
)

MAX_BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Settings:
    """Everything a run can be told.

    ``categories`` is an ordered tuple of (name, nu); a category's code is its
    1-based position. Left empty, the categories are the distinct labels of the
    corpus in name order, all with ``default_nu``.
    """

    corpus_name: str = "corpus"
    corpus_directory: str | None = None
    score_threshold: float = 0.01
    cost: float = 32.0
    gamma: float = 0.125
    categories: tuple[tuple[str, float], ...] = field(default=())
    default_nu: float = 0.1
    train_fraction: float = 0.6
    # Split by a hash of label and id: stable when documents come or go, and without a sort.
    split_by_hash: bool = False
    fourier_dims: int = 256
    seed: int = 42
    max_iterations: int = 50
    tolerance: float = 1e-3
    # Tasks that the texts are read in at least. Files that Spark cannot split (one row group, gzip) give
    # one task each, however large they are; their rows are then dealt out. None leaves the scan as it is.
    read_partitions: int | None = None
    # A larger dictionary is shuffled to its documents instead of broadcast.
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES

    @property
    def category_names(self) -> list[str] | None:
        return [name for name, _ in self.categories] or None

    def nu_of(self, label: str) -> float:
        return dict(self.categories).get(label, self.default_nu)

    @classmethod
    def from_properties(cls, path: str, **overrides) -> "Settings":
        """Read ``key=value`` lines: ``corpus.*`` keys and ``category.<name>=nu``."""
        plain: dict[str, str] = {}
        categories: dict[str, float] = {}
        with open(path, encoding="utf-8") as lines:
            for raw in lines:
                line = raw.strip()
                if not line or line.startswith(("#", "!")):
                    continue
                key, _, value = (part.strip() for part in line.partition("="))
                if key.startswith("category."):
                    categories[key.removeprefix("category.")] = float(value)
                else:
                    plain[key] = value
        values = {
            "corpus_name": plain["corpus.name"],
            "corpus_directory": plain["corpus.directory"],
            "score_threshold": float(plain["corpus.dr.threshold"]),
            "cost": float(plain["corpus.cost"]),
            "gamma": float(plain["corpus.gamma"]),
            "categories": tuple(categories.items()),
        }
        return cls(**{**values, **overrides})
