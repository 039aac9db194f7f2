"""Part of panelweave."""
