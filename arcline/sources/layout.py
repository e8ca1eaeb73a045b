"""One root folder; tables are partitioned by season, split, version or model."""

from __future__ import annotations

from dataclasses import dataclass

RAW_DATASETS = ("shot_chart", "player_game_logs", "team_game_logs", "play_by_play")
SUMMARIES = ("players", "teams", "zones", "trends")


@dataclass(frozen=True)
class Layout:
    root: str

    def raw(self, dataset: str, kind: str = "parquet") -> str:
        if dataset not in RAW_DATASETS:
            raise ValueError(f"unknown raw dataset {dataset!r}, expected one of {RAW_DATASETS}")
        return f"{self.root}/raw/{kind}/{dataset}"

    def raw_season(self, dataset: str, season: str, kind: str = "parquet") -> str:
        return f"{self.raw(dataset, kind)}/season={season}"

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def form_state(self, kind: str, season: str) -> str:
        """Last rows per player or team at the end of a season."""
        return f"{self.root}/state/form/{kind}/season={season}"

    @property
    def gold(self) -> str:
        return self.table("gold_shot_features")

    def splits(self, season: str) -> str:
        return f"{self.root}/features/season={season}"

    def split(self, season: str, name: str) -> str:
        return f"{self.splits(season)}/split={name}"

    def predictions(self, season: str, model: str) -> str:
        return f"{self.root}/predictions/season={season}/model={model}"

    def summary(self, season: str, name: str) -> str:
        if name not in SUMMARIES:
            raise ValueError(f"unknown summary {name!r}, expected one of {SUMMARIES}")
        return f"{self.root}/summaries/{name}/season={season}"

    @property
    def manifest(self) -> str:
        return f"{self.root}/metadata/manifest"

    @property
    def runs(self) -> str:
        return f"{self.root}/metadata/runs"

    @property
    def importance(self) -> str:
        return f"{self.root}/metadata/importance"

    def model(self, name: str, version: str) -> str:
        return f"{self.root}/models/{name}/{version}"

    @property
    def aliases(self) -> str:
        return f"{self.root}/models/aliases"
