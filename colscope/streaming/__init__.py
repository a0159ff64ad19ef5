from colscope.streaming.audit import rule_counts

__all__ = ["rule_counts"]
