"""Sources and sinks: mesh files, trajectories, kernel stores, generators."""
