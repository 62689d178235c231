from anchorline.operators.impute.chained import fit_chained, impute_chained
from anchorline.operators.impute.compare import impute_compare
from anchorline.operators.impute.em import fit_em, impute_em
from anchorline.operators.impute.forest import impute_forest
from anchorline.operators.impute.knn import impute_knn
from anchorline.operators.impute.simple import fit_mean, fit_median, fit_mode, impute_mean, impute_median, impute_mode

__all__ = [
    "fit_chained",
    "fit_em",
    "fit_mean",
    "fit_median",
    "fit_mode",
    "impute_chained",
    "impute_compare",
    "impute_em",
    "impute_forest",
    "impute_knn",
    "impute_mean",
    "impute_median",
    "impute_mode",
]
