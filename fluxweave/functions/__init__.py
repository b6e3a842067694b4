from fluxweave.functions import matrix, scalars

__all__ = ["matrix", "scalars"]
