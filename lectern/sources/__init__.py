"""Sources and sinks: table loading, file discovery, manifests, the chunk store."""
