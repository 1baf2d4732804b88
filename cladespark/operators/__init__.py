"""Operators over alignments, distances, trees and posterior samples."""
