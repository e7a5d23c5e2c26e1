"""DataFrame operators on pixel, tile, cluster and outline tables."""
