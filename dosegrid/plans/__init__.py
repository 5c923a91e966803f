from dosegrid.plans.encoding import encode_panel, refresh_panel
from dosegrid.plans.matrix import panel_score_matrix
from dosegrid.plans.scoring import prepare_associations, score_run

__all__ = ["encode_panel", "panel_score_matrix", "prepare_associations", "refresh_panel", "score_run"]
