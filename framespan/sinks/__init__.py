"""Writers of timelines, levels, transcripts and subtitles."""
