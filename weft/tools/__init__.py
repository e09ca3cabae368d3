"""Tools over texts, found by ``Tools.discover("weft.tools")``."""
