"""Plain parameter dataclasses (the reference's command-line defaults)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
import json


@dataclass(frozen=True)
class BlockSpec:
    """One text block of the content vector."""
    name: str            # block id used as key prefix: 'g', 'a', 't'
    column: str          # source column
    ngram: tuple[int, int] = (1, 1)
    min_df: int = 1
    max_df: float = 1.0  # fraction of documents
    max_features: int | None = None
    doc: str = "plain"   # 'genre' (D1 delimiter clean-up) or 'plain' (lower + strip)


@dataclass(frozen=True)
class FeatureConfig:
    """Trainer defaults (fixed values): weights 1.0/1.0/0.2/0.6; genre (1,2) min_df 2 max 50,000;
    artist (1,1) min_df 1 max 10,000; title (1,2) min_df 2 max 60,000."""
    genre_weight: float = 1.0
    artist_weight: float = 1.0
    title_weight: float = 0.2
    numeric_weight: float = 0.6
    use_title: bool = True
    blocks: tuple[BlockSpec, ...] = field(default_factory=lambda: (
        BlockSpec("g", "artist_genres", (1, 2), 2, 1.0, 50000, "genre"),
        BlockSpec("a", "artist_name", (1, 1), 1, 1.0, 10000, "plain"),
        BlockSpec("t", "track_name", (1, 2), 2, 1.0, 60000, "plain"),
    ))

    def weights(self) -> dict[str, float]:
        w = {"g": self.genre_weight, "a": self.artist_weight, "t": self.title_weight}
        return {b.name: w.get(b.name, 1.0) for b in self.active_blocks()}

    def active_blocks(self) -> tuple[BlockSpec, ...]:
        return tuple(b for b in self.blocks if self.use_title or b.name != "t")

    def with_weights(self, genre=None, artist=None, title=None, numeric=None) -> "FeatureConfig":
        return FeatureConfig(
            genre if genre is not None else self.genre_weight,
            artist if artist is not None else self.artist_weight,
            title if title is not None else self.title_weight,
            numeric if numeric is not None else self.numeric_weight,
            self.use_title, self.blocks)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


# fixed values (D13): the three named variants of the model trainer
VARIANTS = {
    "content_genre_artist": FeatureConfig(1.5, 1.0, 0.2, 0.5, use_title=False),
    "content_genre_artist_title": FeatureConfig(1.2, 1.0, 0.3, 0.6, use_title=True),
    "content_artist_heavy": FeatureConfig(0.8, 2.0, 0.2, 0.4, use_title=False),
}


@dataclass(frozen=True)
class RecommendParams:
    top_k: int = 10
    score_threshold: float = 0.20
    one_per_artist: bool = True
    overfetch: int = 50


@dataclass(frozen=True)
class EvalParams:
    k: int = 10
    seeds: int = 200
    random_state: int = 42
    relevance: str = "artist"   # 'artist' | 'genre' | 'either'
