from seqlens.plans import catalog, export, landed, reports

__all__ = ["catalog", "export", "landed", "reports"]
