"""Writers: EPUB, static site, review list, narration."""
