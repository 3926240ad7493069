"""Sources: scans of ledgers, evidence, playlists, packages and remote catalogs."""
