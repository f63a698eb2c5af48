"""DataFrame operators over step tables: episodes, windows, tubelets, selection, sampling, tensors."""
