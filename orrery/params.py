"""Parameters as a frozen value that is passed on; there is no global state."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Effective defaults of a prediction run. Distances are in the unit of the coordinates."""

    neighbourhood_radius: float = 6.0
    protrusion_radius: float = 10.0
    solvent_radius: float = 1.6
    surface_additional_cutoff: float = 2.5
    pred_point_threshold: float = 0.35
    pred_clustering_dist: float = 3.0
    pred_min_cluster_size: int = 3
    extended_pocket_cutoff: float = 3.5
    pred_protein_surface_cutoff: float = 3.5
    point_score_pow: float = 2.0
    score_point_limit: int = 0
    ligand_protein_contact_distance: float = 4.0
    ligand_center_distance: float = 5.5
    ligand_clustering_distance: float = 1.7
    min_ligand_atoms: int = 5
    positive_point_ligand_distance: float = 2.6
    neutral_points_margin: float = 5.5
    ligand_induced_volume_cutoff: float = 2.5
    residue_score_extra_dist: float = 2.0
    weight_function: str = "INV"
    eval_tolerances: tuple[int, ...] = (0, 1, 2, 4, 10, 99)
    predictions: bool = True
    train_pockets: int = 9
    seed: int = 42
    folds: int = 5

    @property
    def sas_cutoff(self) -> float:
        return self.solvent_radius + self.surface_additional_cutoff

    def rescoring(self) -> "Params":
        """The profile for rescoring loaded pockets: only the values it names change."""
        return replace(
            self, neighbourhood_radius=8.0, positive_point_ligand_distance=2.5, pred_point_threshold=0.4,
            pred_clustering_dist=5.0, surface_additional_cutoff=1.8, train_pockets=0, predictions=False,
        )

    def with_json(self, text: str) -> "Params":
        """Override values from a JSON object; unknown names are an error."""
        given = json.loads(text)
        known = {f.name for f in fields(self)}
        if extra := set(given) - known:
            raise ValueError(f"unknown parameters: {sorted(extra)}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
