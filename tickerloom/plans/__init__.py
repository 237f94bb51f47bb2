"""The dataflows, ready to use."""

from tickerloom.plans.pipelines import Decision, candidate_snapshot, decide, merge_feedback, premium_features, premium_predict, premium_train

__all__ = ["Decision", "candidate_snapshot", "decide", "merge_feedback", "premium_features", "premium_predict", "premium_train"]
