"""postlens: DataFrame operators for observed social posts and structured listings."""
