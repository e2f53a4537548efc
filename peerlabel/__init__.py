"""Semi-supervised classification of Spark tables by co-training ensembles."""

from peerlabel.config import CoTrainConfig
from peerlabel.operators.members import (
    BucketMember,
    ClassifierMember,
    bucket_members,
    logistic_members,
    member_subspaces,
    tree_members,
)
from peerlabel.plans.cotrain import CoTrainResult, cotrain
from peerlabel.plans.jobs import cotrain_partly_labelled, cotrain_split, supervised_baseline

__all__ = [
    "BucketMember",
    "ClassifierMember",
    "CoTrainConfig",
    "CoTrainResult",
    "bucket_members",
    "cotrain",
    "cotrain_partly_labelled",
    "cotrain_split",
    "logistic_members",
    "member_subspaces",
    "supervised_baseline",
    "tree_members",
]
