from .resume import append_new, follow_runs

__all__ = ["append_new", "follow_runs"]
