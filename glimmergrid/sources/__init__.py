"""Where rows come from and go to: files, archives, frames, stores and record files."""
