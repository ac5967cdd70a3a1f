"""Readers that give levels, samples, cues, frames, clips and timelines."""
